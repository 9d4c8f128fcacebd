"""The alignment of two tokenizers against a plain version: whole texts, every pair of tokens, counts by set."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from loomgraph.llm import alignment, queries
from tests.compare import rows

NAMES = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*map(public_tokenizers.path, NAMES))


def _plain(aligner, text):
    """``(a, b, groups, links)`` of a text, or None, by the tokenizers on the whole text."""
    if not text:
        return None
    a, b = aligner.full.encode(" " + text, add_special_tokens=False).ids, aligner.pieces.encode(text)
    bytes_a, bytes_b = [aligner.a_bytes[x] for x in a], [aligner.b_bytes[x] for x in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    at_a, at_b = [0], [0]
    for x in bytes_a:
        at_a.append(at_a[-1] + len(x))
    for x in bytes_b:
        at_b.append(at_b[-1] + len(x))
    ends, groups, i, j = sorted(set(at_a) & set(at_b)), [], 0, 0
    for end in ends[1:]:
        from_i, from_j = i, j
        i, j = at_a.index(end, i), at_b.index(end, j)
        groups.append(",".join(map(str, a[from_i:i])) + "|" + ",".join(map(str, b[from_j:j])))
    links = Counter()
    first = 0
    for i, x in enumerate(a):
        while at_b[first + 1] <= at_a[i]:
            first += 1
        j = first
        while j < len(b) and at_b[j] < at_a[i + 1]:
            links[x, b[j]] += 1
            j += 1
    return a, b, groups, links


def _plain_rows(aligner, docs):
    each = [(d, _plain(aligner, t)) for d, t in docs]
    count = Counter(p for _, x in each if x for p in x[3])
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for d, x in each:
        if x is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = x
            n_best = sum(m for p, m in links.items() if count[p] == best[p[0]])
            out.append((d, len(a), len(b), len(groups), sum(links.values()), n_best, sum(m * count[p] for p, m in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def _got(frame):
    return [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in frame.collect()]


_SPECIAL = ["<|endoftext|>", " ", "<s>", "</s>", "<0x0A>", "▁", "x", "<unk>", "\n"]
_POOLS = ["ab cd ef.,\n\t  ", "  \n\r\t\x0b\x0c\x1c\x1f\x85  　 x1.'", "aéßœ İ ı ǅ ", "漢字 かな ", "😀 🇩🇪 ‍ é́ ", _SPECIAL, "'s 're don't 12 3456 ;\r\n }\r", "\x01 a\x01 b\n\x01", "\x02 \x00q"]


def test_chunks_give_the_tokens_of_whole_texts(aligner):
    rng = random.Random(11)
    pools = [*_POOLS, *["".join(map(chr, range(at, at + 60))) + " " for at in range(0, 0x250, 60)]]
    known = alignment._Interned(aligner)
    texts = ["".join(rng.choices(rng.choice(pools), k=rng.randrange(30))) for _ in range(1500)]
    for t, r in zip(texts, alignment._lot([0] * len(texts), texts, known).to_pylist(), strict=True):
        want = _plain(aligner, t)
        assert r["groups_sha256"] == ("" if want is None else hashlib.sha256(";".join(want[2]).encode()).hexdigest()), repr(t)
        links = Counter()
        for g, m in zip(r["groups"], r["times"], strict=True):
            for x in aligner.links(g):
                links[x >> 16, x & 0xFFFF] += m
        assert links == (want[3] if want else {}) and r["n_links"] == sum(links.values())


def test_no_piece_reaches_over_a_cut(aligner):
    for i in range(aligner.pieces.get_piece_size()):
        p = aligner.pieces.id_to_piece(i)
        assert "▁" not in p.lstrip("▁") and "\n" not in p


@pytest.mark.parametrize("common", [100_000, 3])
def test_odd_documents(spark, aligner, common):
    rng = random.Random(4)
    texts = ["the cat's hats", "the cat's hats", None, "", " ", "\n", "aaaaaaaaaaaa aaaaaaa", "▁ no", "é" * 3000, "word " * 20_000, "x" * 20_000, "tail \n\n", "<|endoftext|> here", "the  hats   of"]
    texts += ["".join(rng.choices(rng.choice(_POOLS), k=40)) for _ in range(60)] + ["one line that many hold\nand more"] * 80
    docs = [(k % 40 if k % 9 else None, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*d, "g", 1, 2, 3) for d in docs], "doc_id long, text string, group string, doc int, n int, pair int").repartition(5)
    out = alignment.align(df, *map(public_tokenizers.path, NAMES), common=common)
    assert sorted(_got(out), key=str) == sorted(_plain_rows(aligner, docs), key=str)
    assert alignment.align(df.limit(0), *map(public_tokenizers.path, NAMES)).count() == 0


def test_query_against_a_plain_version(spark, aligner, sf_dir):
    out = queries.queries()["op11_alignment"](spark, sf_dir)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(_got(out)) == sorted(_plain_rows(aligner, docs))
    again = queries.op11_alignment(spark, sf_dir).toPandas()
    assert rows(out.toPandas()) == rows(again)
