"""Line dedup and the filter audit against brute force on small tables, and against their SQL on the given ones."""

import itertools
import re

import duckdb
import pytest

from tessera.llm import filter_audit, line_dedup, queries

WHITE = " \t\n\x0b\f\r"
LINED = [None, "", "\n", "a", "A \nb", "\ta\n\nb\n", "É\né", "x\x1c\nx", "a\na\na", "  ", "only once", "one\r\ntwo\r\n", "é " * 3000 + "\nshared LINE\n" + "tail", "shared line\nown",
         "Shared Line", "\x0bshared line\f\nz\nz", "a\nB\nc", "b", "B\n", "n\n" * 5000]


def brute_lines(rows, min_docs, min_chars=1):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(WHITE))
    split = [(i, (t or "").split("\n")) for i, t in rows]
    seen = {}
    for n, (_, lines) in enumerate(split):
        for key in {low(x) for x in lines}:
            seen.setdefault(key, set()).add(n)
    hot = {k for k, at in seen.items() if len(at) >= min_docs and len(k) >= min_chars}
    return [(i, len(lines), sum(low(x) in hot for x in lines), "\n".join(x for x in lines if low(x) not in hot)) for i, lines in split]


def lined(spark, rows):
    return spark.createDataFrame([(i, t, 5, "clash") for i, t in rows], "doc_id long, text string, n_lines int, places string")


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
@pytest.mark.parametrize(("min_docs", "min_chars"), [(2, 1), (3, 2), (4, 0), (99, 1)])
def test_line_dedup_equals_brute_force(spark, min_docs, min_chars, broadcast_rows):
    rows = [*enumerate(LINED), (3, "a"), (None, "b\nown"), (None, None)]
    docs = lined(spark, rows)
    got = line_dedup.decisions(docs, min_docs=min_docs, min_chars=min_chars, broadcast_rows=broadcast_rows).collect()
    want = brute_lines(rows, min_docs, min_chars)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = line_dedup.filter_documents(docs, min_docs=min_docs, min_chars=min_chars, broadcast_rows=broadcast_rows)
    assert kept.columns == docs.columns
    assert sorted(str(tuple(r)) for r in kept.collect()) == sorted(str((i, k, 5, "clash")) for i, _, _, k in want)


def test_line_dedup_of_a_hot_line_and_copies(spark):
    rows = [(i, f"banner\nown {i}") for i in range(200)] + [(1000 + i, "copy one\nbanner\ncopy two") for i in range(300)]
    got = line_dedup.decisions(lined(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_lines(rows, 10))
    assert line_dedup.decisions(lined(spark, rows).limit(0)).count() == 0 == line_dedup.filter_documents(lined(spark, []), min_docs=2).count()


def brute_audit(rows, labels):
    first, out = {}, {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": re.search("[#$%&*|]", t) is not None,
             "E": t in first and (i is None or first[t] < i)}
        mine = [x for x in labels if x[0] == i and i is not None]
        fails.append((part or "", {k for k, v in f.items() if v}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    for part in {f[0] for f in fails}:
        here = [f for f in fails if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = here
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in here) - len(gone)
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(r[1] == {f} for r in here), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shapley[v[-1]]
    return sorted((*k, *v) for k, v in out.items())


def test_audit_equals_brute_force(spark):
    prose = " ".join(f"word{i}" for i in range(220))
    texts = [None, "", " \t", "a b a b a", "ABC", "x $", prose, prose, prose + " ", "x" * 64 + "y", "x" * 64 + "z", "y" * 20_000, "y" * 20_000, "y" * 20_001, "y" * 19_999 + "z", "é" * 1030, "é" * 1030,
             "A" * 3 + " b" * 300, "🙂 A" * 90, "\x1c" * 5, "", None]
    rows = [(i, t, ["s", None, "", "t u"][i % 4]) for i, t in enumerate(texts)]
    rows += [(6, prose, "s"), (None, prose, "s"), (None, "no id", None), (None, "no id", "s"), (-4, "y" * 20_000, "u"), (3, None, "s")]
    labels = [(0, 1, 0), (3, 1, 1), (6, 1, 0), (6, 0, 1), (7, None, 1), (None, 1, 1), (12, 1, 0), (999, 1, 1), (20, 1, None)]
    docs = spark.createDataFrame([(*r, 7, "clash") for r in rows], "doc_id long, text string, source string, mask int, part string")
    labelled = spark.createDataFrame([(*r, "clash") for r in labels], "doc_id long, quality int, toxic int, mask string")
    got = filter_audit.audit(docs, labelled)
    columns = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert got.columns == columns and sorted(map(tuple, got.collect())) == brute_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), labelled).count() == 0
    assert {r["good_lost"] + r["toxic_lost"] for r in filter_audit.audit(docs, labelled.limit(0)).collect()} == {0}


def test_audit_of_hot_copies(spark):
    rows = [(i, "the same text here", "s") for i in range(300)] + [(1000 + i, f"text {i}", "s") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    fails = filter_audit.masks(docs).where(f"mask & {filter_audit.DUPLICATE} <> 0")
    assert sorted(r["doc_id"] for r in fails.collect()) == list(range(1, 300))


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_line_dedup"])
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for table in ("documents", "labels"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want, got = c.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(r[x] for x in columns) for r in got.collect()) == sorted(want.select(*[f'"{x}"' for x in columns]).fetchall())


def test_line_dedup_has_no_python_and_splits_once(spark, sf):
    plan = queries.QUERIES["op12_line_dedup"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow|CartesianProduct|NestedLoop", plan)
    assert not re.search(r"lambdafunction\([^\n]*split\(", plan)
