from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomgraph.llm.queries import tokenizer_path
from tests.llm.test_operators import DOCS, ODD, _brute_components, _sets


def test_stages(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from loomgraph.llm import exact_dedup

    monkeypatch.setattr(corpus_pipeline, "table", lambda s, _, name: s.createDataFrame([], "doc_id long, quality int, toxic int"))
    docs = spark.createDataFrame([*ODD, (8, "A b c d e f  G", "en", "s", 1, 9, 1, 1, 1, "k", 0.5, 1, "b")], DOCS)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(names) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
    assert seen["toxicity"].count() == len(ODD) + 1
    digests = exact_dedup.exact_groups(seen["exact_dedup"])
    assert digests.where("group_size > 1").count() == 0 and seen["exact_dedup"].count() == 6
    assert {r["doc_id"] for r in seen["near_dedup"].collect()} == {r["doc_id"] for r in seen["exact_dedup"].collect()} - {8}
    assert seen["packing"].count() > 0


def test_run(spark, sf_dir):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, sf_dir).count() > 100


def test_near_stage_links_from_80(spark, tmp_path):
    import corpus_pipeline

    docs = []
    for k, n in enumerate((44, 45, 51)):  # shingles; one changed word in the middle leaves n - 5 of n + 5: 0.796, 0.800, 0.821
        w = [f"t{k}w{i}" for i in range(n + 4)]
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:20], "other", *w[21:]]))]
    left = corpus_pipeline.apart(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path))
    assert {r["doc_id"] for r in left.collect()} == {0, 1, 2, 4}


@pytest.mark.parametrize("clash", ["unique_key", "gone_key", "mix_key", "mix_copies", "mix_copy", "GONE_KEY", "size", "row_key", "text_sha256"])
def test_clashing_columns(spark, tmp_path, clash):
    import corpus_pipeline

    docs = spark.createDataFrame([(k, f"a b c d e f g h {k}", "s", "same") for k in range(4)] + [(9, None, None, None)], f"doc_id long, text string, source string, {clash} string")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() > 0, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def _fixture():
    """Labelled documents of three sources with toxic ones, exact copies that differ in white space, and near copies around 0.80."""
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(500)]
    docs, labels = [], []

    def add(text, toxic=None):
        docs.append((len(docs), text, [None, "b", "a", "c"][len(docs) % 4], "en", len(text or "")))
        if toxic is not None:
            labels.append((len(docs) - 1, 1, toxic))

    for k in range(240):
        w = list(rng.choice(words, int(rng.integers(30, 90))))
        if k % 3 == 0:
            for at in (3, 9, 20):
                w.insert(at, "zz" + str(rng.choice(["rude", "vile", "foul"])))
        add(" ".join(w), int(k % 3 == 0))
    for k in range(40):
        text = docs[3 * k + 1][1]
        add(text.replace(" ", "\n  ", 1 + k % 2))
    for k, n in enumerate((44, 45, 46, 48, 51, 54, 60, 70)):  # one changed word in the middle leaves n - 5 of n + 5 shingles
        w = [f"t{k}w{i}" for i in range(n + 4)]
        add(" ".join(w))
        add(" ".join([*w[:20], "other", *w[21:]]))
    add(None)
    add("")
    return docs, labels


def _plain_mix(docs):
    """Copies by document: sources share by weight below their caps, documents in order of size class, size and doc_id."""
    order = sorted({d[2] for d in docs}, key=lambda s: (s is None, s or ""))
    size = {d[0]: len((d[1] or "").split()) for d in docs}
    of = {s: sum(size[d[0]] for d in docs if d[2] == s) for s in order}
    weight, left, target = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(of.values()), {}
    while open_ := [s for s in order if s not in target]:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * share >= 2 * of[s]]
        for s in full or open_:
            target[s] = min(2 * of[s], weight[s] * share)
        left -= sum(target[s] for s in full)
    copies = {}
    for s in order:
        offset = int(hashlib.md5(f"mix/{chr(0) if s is None else s}".encode()).hexdigest()[:8], 16) % 65536 / 65536
        rate = target[s] / of[s] if of[s] else 0
        for place, k in enumerate(sorted((d[0] for d in docs if d[2] == s), key=lambda k: (len(f"{size[k]:b}"), size[k], k)), 1):
            copies[k] = (math.floor(offset + place * rate) - math.floor(offset + (place - 1) * rate)) if size[k] else 0
    return copies


def test_run_against_a_plain_version(spark, tmp_path):
    import corpus_pipeline

    docs, labels = _fixture()
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    text = {d[0]: d[1] for d in docs}
    left = [d for d in docs if "zz" not in (d[1] or "")]
    best = {}
    for d in left:
        digest = "".join((d[1] or "").split())
        best[digest] = min(best.get(digest, (0, 1 << 40, None)), (-len(d[1] or ""), d[0], d))
    left = sorted(x[2] for x in best.values())
    sets = {d[0]: _sets(d[1]) for d in left}
    root = _brute_components(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    left = [d for d in left if root[d[0]] == d[0]]
    copies = _plain_mix(left)
    tok = Tokenizer.from_file(tokenizer_path())
    tokens = {k: [*tok.encode(text[k] or "", add_special_tokens=False).ids, 2] for k in copies if copies[k]}

    seen, stages = {}, corpus_pipeline.STAGES
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in stages[:4]:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = sorted(r["doc_id"] for r in now.select("doc_id").collect())
    assert seen["toxicity"] == [d[0] for d in docs if "zz" not in (d[1] or "")]
    assert seen["exact_dedup"] == sorted(x[1] for x in best.values())
    assert seen["near_dedup"] == sorted(d[0] for d in left) and len(seen["near_dedup"]) < len(seen["exact_dedup"])
    assert seen["mixing"] == sorted(k for k, n in copies.items() for _ in range(n))
    pieces, windows = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        ids = tokens[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).extend(range(r["start"], r["start"] + r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(list(range(len(ids))) * copies[k]) for k, ids in tokens.items()}
    for w in windows.values():
        assert [a for a, _ in sorted(w)] == [sum(n for _, n in sorted(w)[:i]) for i in range(len(w))] and sum(n for _, n in w) <= 4096
