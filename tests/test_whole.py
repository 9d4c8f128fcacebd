"""Queries over whole tables and texts that have no SQL, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from loomgraph import registry
from loomgraph.functions import comments
from loomgraph.operators import files
from tests.compare import rows


def _names(line):
    for part in re.sub(r"[()\\\r]", " ", line).split(","):
        if m := re.match(r"[A-Za-z_][A-Za-z0-9_.]*", part.strip(" ")):
            yield m[0]


def test_py_names(spark, sf_dir, tmp_path):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(-1, "(a, b as c, \\\r\n  d.e)\n*, f\n"), (-2, None), (-3, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["name"]): r["n"] for r in registry.queries()["py_names_explode"](spark, str(tmp_path)).collect()}
    assert got == Counter((k, name) for k, text in docs for line in (text or "").split("\n") for name in _names(line))
    assert {name for k, name in got if k == -1} == {"a", "b", "d.e", "f"}


#: Code that stands alone, and what is left of it when each of its lines but the last of a file ends in a comment.
_C = [
    ("a = 1", "a = 1 "), ("b /* c */ + 2", "b   + 2 "), ('s = "// no" // yes', 's = "// no" '), ("/* x\ny ' z */ q", "\n q "), ("r = /[/*]'/g;", "r = /[/*]'/g; "),
    ("t = `u // v ${`in /* */`} w`", "t = `u // v ${`in /* */`} w` "), ("u = 'it\\'s' + \"/*\"", "u = 'it\\'s' + \"/*\" "), ("", " "),
]
_PY = [("a = 1 # b", "a = 1 "), ("s = '# no' # it's", "s = '# no' "), ('"""x\n# y"""z', "\nz "), ("b // c", "b // c "), ("", " ")]


def _files(spark, tmp_path, docs):
    spark.createDataFrame([(k, t, "en", "s") for k, t in docs], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_strip_comments_whole(spark, tmp_path):
    rng = random.Random(5)
    docs, want = [], {}
    for k in range(40):
        parts = rng.choices(_PY if k % 4 == 1 else _C, k=2000 if k < 4 else 20)
        docs.append((k, "".join(a + "\n" for a, _ in parts) + "end"))
        want[f"src/s/en/d{k}.{['ts', 'py', 'sql', 'js'][k % 4]}"] = "".join(b + "\n" for _, b in parts) + "end"
    got = {r["path"]: r["clean"] for r in registry.queries()["strip_comments_whole"](spark, _files(spark, tmp_path, docs)).collect()}
    assert got == want


def test_strippers_take_small_batches(spark):
    """More rows than a batch, and than are held as strings at once; settings of the user's that are smaller stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    texts = [(k, None if k % 97 == 0 else f"a{k} // b", ".js") for k in range(2500)]
    df = spark.createDataFrame(texts, "k int, t string, e string").coalesce(1)
    before = spark.conf.get(key)
    try:
        for rows_, want in (("10000", "1000"), ("7", "7")):
            spark.conf.set(key, rows_)
            got = df.select("k", comments.clean_text("t", "e").alias("c"), comments.fence_open("t").alias("f"))
            assert spark.conf.get(key) == want
            assert {(r["k"], r["c"], r["f"]) for r in got.collect()} == {(k, t and f"a{k} ", t and False) for k, t, _ in texts}
    finally:
        spark.conf.set(key, before)


#: Text with its own fences, and what is left of it with a fenced block of three lines at each end of a line.
_MD = [("plain `x`", "plain `x`"), ("> ```\n~~~\n``` no\n> ```", "\n" * 12), ("   `````\nb\n```", "\n" * 8), ("", "")]


def test_fence_strip(spark, sf_dir, tmp_path):
    rng = random.Random(6)
    docs, want = [], {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        lines = r["text"].split("\n")
        assert not any(re.match(r"[\s>]*(```|~~~)", x) for x in lines)
        docs.append((r["doc_id"], r["text"]))
        want[r["doc_id"]] = "\n\n\n\n".join(lines)
    for k in range(10_000, 10_040):
        parts = rng.choices(_MD, k=500 if k % 10 == 0 else 10)
        docs.append((k, "\n".join(a for a, _ in parts)))
        want[k] = "\n\n\n\n".join(b for _, b in parts)
    got = {r["doc_id"]: (r["clean"], r["unclosed"]) for r in registry.queries()["fence_strip"](spark, _files(spark, tmp_path, docs)).collect()}
    assert got == {k: (t + "\n\n" * (k % 4 == 3), k % 4 == 3) for k, t in want.items()}


def test_graph_over_all_edges(spark, sf_dir):
    events = sorted((r["ts"], r["event_id"], r["user_id"], r["event_type"]) for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect())
    nodes = {u for _, _, u, _ in events}
    errors = [(k, u) for _, k, u, kind in events if kind == "error"]
    flags = {}
    for (k, a), (_, b) in zip(errors, errors[1:], strict=False):
        if a != b:
            value, lazy = flags.get((a, b), (False, False))
            flags[a, b] = value or k % 70 != 0, lazy or k % 30 == 0
    q = lambda name: registry.queries()[name](spark, sf_dir).collect()
    assert {(r["src"], r["dst"]): (r["is_value"], r["is_lazy"], r["is_static"]) for r in q("edge_flags")} == {e: (v, z, v and not z) for e, (v, z) in flags.items()}
    assert {r["id"]: (r["fan_out"], r["fan_in"]) for r in q("fan_in_out")} == {n: (sum(a == n for a, _ in flags), sum(b == n for _, b in flags)) for n in {x for e in flags for x in e}}

    outs = {n: [b for (a, b), (v, _) in flags.items() if a == n and v] for n in nodes}
    rank = {n: 1 / len(nodes) for n in nodes}
    for _ in range(30):
        lost = sum(rank[n] for n in nodes if not outs[n])
        rank = {n: 0.15 / len(nodes) + 0.85 * (lost / len(nodes) + sum(rank[a] / len(outs[a]) for a in nodes if n in outs[a])) for n in nodes}
    got = {r["id"]: r["rank"] for r in q("pagerank")}
    assert got.keys() == rank.keys() and all(abs(got[n] - rank[n]) < 1e-8 for n in nodes)

    def reach(start):
        seen, todo = {n: 0 for n in start}, list(start)
        for a in todo:
            for x, b in flags:
                if x == a and b not in seen:
                    seen[b] = seen[a] + 1
                    todo.append(b)
        return seen

    hops = reach([n for n in nodes if n % 17 == 0])
    assert {r["id"]: r["hops"] for r in q("bfs_hops")} == {n: hops.get(n) for n in nodes}
    via = {n: [n] for n in hops if hops[n] == 0}
    for n in sorted(hops, key=hops.get):
        if hops[n]:
            via[n] = sorted({v for a, b in flags if b == n and hops.get(a) == hops[n] - 1 for v in via[a]})[:3]
    assert {r["id"]: r["via"] for r in q("bfs_provenance")} == {n: ",".join(map(str, via.get(n, []))) for n in nodes}
    assert {(r["via"], r["id"], r["hops"]) for r in q("surface_paths")} == {(via[n][0], n, h) for n, h in hops.items() if h}
    more = {r["c_custkey"] for r in spark.read.parquet(f"{sf_dir}/customer.parquet").collect()}
    assert {r["id"] for r in q("orphans")} == {n for n in nodes | more if n not in hops and n % 5}
    ahead = {n: set(reach([n])) for n in nodes}
    ring = {n: {m for m in ahead[n] if n in ahead[m]} for n in nodes}
    assert {r["id"]: r["component"] for r in q("scc")} == {n: min(ring[n]) for n in nodes if len(ring[n]) > 1}
    for r in q("cycle_witness"):
        c = [int(x) for x in r["cycle"].split(">")]
        assert c[0] == c[-1] and all(e in flags for e in zip(c, c[1:], strict=False))
    counts = q("global_counts")[0]
    assert (counts["edges"], counts["value_edges"]) == (len(flags), sum(v for v, _ in flags.values()))
    fan = Counter(b for _, b in flags)
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    loc = {k: sum(bool(x.strip()) and not re.match(r"\s*(//|#|\*|/\*|--)", x) for x in t.split("\n")) for k, t in text.items()}
    damped = {n: rank[n] * (0.25 + 0.75 * loc[n] / (loc[n] + 60)) * fan[n] / (fan[n] + 4) for n in nodes if n in loc}
    got = {r["id"]: r["importance"] for r in q("importance_damped")}
    assert got.keys() == damped.keys() and all(abs(got[n] - damped[n]) < 1e-8 for n in damped)
    assert len(q("hotspot_score")) == min(100, len(text))


def test_staleness_sections_runs_the_operator(spark, sf_dir, monkeypatch):
    from loomgraph.operators import staleness

    calls, stale = [], staleness.stale
    monkeypatch.setattr(staleness, "stale", lambda *a, **b: calls.append(a) or stale(*a, **b))
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("orders", "lineitem"))
    at = {r["o_orderkey"]: r["o_orderdate"] for r in orders}
    later = [(r["l_orderkey"], str(r["l_linenumber"])) for r in lines if r["l_orderkey"] in at and r["l_shipdate"] > at[r["l_orderkey"]]]
    n, changed = Counter(k for k, _ in later), {}
    for k, x in later:
        changed.setdefault(k, set()).add(x)
    got = {r["id"]: (r["changes"], r["changed"]) for r in registry.queries()["staleness_sections"](spark, sf_dir).collect()}
    assert calls and got == {k: (n[k], ",".join(sorted(changed[k]))) for k in n}


def _sql(tmp_path, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return con.execute(registry.oracle_sql()[name]).df()


def test_generated_classifier_on_prose_of_short_words(spark, tmp_path):
    """Repeated words of one letter, or of one beside an accent, in lines of ordinary length."""
    docs = [(2, "A A A A A A A A A A\n" * 30), (4, "\u00c9l \u00c9l \u00c9l \u00c9l\n" * 60), (7, "a b\n" * 150), (8, "x" * 400), (9, None), (12, ""), (13, "one word\n" * 200)]
    got = registry.queries()["generated_classifier"](spark, _files(spark, tmp_path, docs)).toPandas()
    assert rows(got) == rows(_sql(tmp_path, "generated_classifier"))


def test_short_names_are_minified_code(spark):
    code = [("a.js", "var a=b(c,d);e.f=g\n" * 60), ("b.js", "  var a=b(c,d);e.f=g\n" * 60), ("c.js", "var one=two(three)\n" * 60)]
    df = spark.createDataFrame(code, "path string, text string").select("path", files.generated_reason(F.col("path"), F.col("text")).alias("r"))
    assert {r["path"]: r["r"] for r in df.collect()} == {"a.js": "minified", "b.js": None, "c.js": None}


def test_redact_takes_the_secrets_of_the_texts_too(spark, tmp_path):
    """The SQL leaves texts as they are; apart from their own secrets the rows are the same."""
    key, token = "AKIA" + "Q" * 16, "9233A8ECF7C5B09F"
    docs = [(20, f"the {key} of"), (21, f'A TOKEN = "{token}"!! B'), (22, "no secret"), (23, f"two {key}\n{key} z"), (24, ""), (25, None)]
    got = registry.queries()["redact"](spark, _files(spark, tmp_path, docs)).toPandas()
    want = _sql(tmp_path, "redact")
    want["clean"] = [t if t is None else t.replace(key, "AKIA***").replace(f'TOKEN = "{token}"', 'TOKEN=***"') for t in want["clean"]]
    assert rows(got) == rows(want)
    assert not any(key in t or token in t for t in got["clean"] if t)


def test_redact_equals_its_sql_on_ids_below_zero(spark, tmp_path):
    docs = [(k, f"text {k}") for k in range(-50, 50)] + [(-60, None), (None, "x")]
    got = registry.queries()["redact"](spark, _files(spark, tmp_path, docs)).toPandas()
    assert rows(got) == rows(_sql(tmp_path, "redact"))


def test_redact_leaves_addresses_around_white_space_as_the_sql_does(spark, tmp_path):
    docs = [(20 + k, f"see https://a{c}b:c@d") for k, c in enumerate("\u00a0\u1680\u2003\u2028\u202f\u205f\u3000\ufeff")]
    got = registry.queries()["redact"](spark, _files(spark, tmp_path, docs)).toPandas()
    assert rows(got) == rows(_sql(tmp_path, "redact"))
