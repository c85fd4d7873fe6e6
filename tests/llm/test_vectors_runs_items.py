"""Whitening, periodic runs and decontamination against plain computations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meterflow.llm import decontaminate, queries, runs, whitening

COLUMNS = "doc_id long, text string, lang string, items string, spans int, runs int, n_words string, h int, row string"
GAP = re.compile(r"[\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in GAP.split(text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Periodic runs


def plain_runs(w, least=6, times=4):
    """Runs by trying every period; of one stretch the smallest period counts."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_run_row(doc_id, text, change=True):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if change and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    return (doc_id, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def periodic_texts(n=250, seed=4):
    rng = random.Random(seed)
    out = [None, "", " \t\n ", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b " * 3 + "a", "é ü " * 40, "x\x1fy x\x1fy " * 6, "a " * 3000 + "b c d " * 900]
    for _ in range(n):
        k = rng.choice([1, 2, 3, 9, 60])
        w = [f"w{rng.randrange(k)}" for _ in range(rng.randint(0, 70))]
        for _ in range(rng.randrange(3)):
            p = [f"w{rng.randrange(k)}" for _ in range(rng.randint(1, 9))]
            at = rng.randint(0, len(w))
            w[at:at] = (p * 9)[: rng.randint(1, 9 * len(p))]
        out.append(rng.choice([" ", "\n", "  "]).join(w))
    return out


def test_runs_against_every_period(spark):
    rows = list(enumerate(periodic_texts())) + [(None, "a b " * 9), (3, "a " * 9), (3, "a " * 9)]
    docs = spark.createDataFrame([(i, t, None, "x", 1, 2, "y", 3, "z") for i, t in rows], COLUMNS).repartition(3)
    got = [tuple(r[c] for c in RUN_COLUMNS) for r in runs.digest(runs.find_runs(docs, runs.repeating)).collect()]
    assert sorted(got, key=repr) == sorted([plain_run_row(i, t) for i, t in rows], key=repr)
    assert sum(r[1] for r in got) > 100


def test_runs_query_over_its_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r[c] for c in RUN_COLUMNS) for r in queries.op12_runs(spark, SF).collect()}
    assert got == {plain_run_row(r.doc_id, r.text) for r in docs}
    assert any(r[1] for r in got)


def test_runs_of_words_over_few_letters():
    rng = random.Random(8)
    for _ in range(600):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 40))]
        assert runs.runs_of(w) == plain_runs(w)
    assert runs.runs_of([0] * 20_000) == [(0, 20_000, 1)]
    with pytest.raises(ValueError):
        runs.runs_of([0, 0], times=2)


def test_segments_of_the_link_cut_tree_are_last_occurrences():
    rng = random.Random(2)
    for _ in range(40):
        ids = [rng.randrange(2) for _ in range(rng.randint(1, 30))]
        length, link, at = runs.suffix_automaton(ids)
        tree = runs.LinkCutTree(link)
        for i, state in enumerate(at):
            expected, longest = [], 0
            for e in range(i - 1, -1, -1):  # a later end hides what an earlier one has in common
                n = next((k for k in range(e + 1) if ids[e - k] != ids[i - k]), e + 1)
                if n > longest:
                    expected, longest = [(n, e), *expected], n
            assert [(length[v], e) for v, e in tree.access(state, i) if length[v]] == expected


def test_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "so it goes on and on and on and on and on end")], "doc_id long, text string")
    row = runs.find_runs(docs, texts=True).first()
    assert [tuple(r) for r in row.runs] == [(3, 9, 2)]
    assert row.collapsed == "so it goes on and end"
    assert runs.digest(runs.find_runs(docs.where("false"))).count() == 0


# Decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(rows, items, window=10):
    found = {}
    for item, text in items:
        w = plain_words(text)
        k = min(window, len(w))
        for p in range(len(w) - k + 1) if k else ():
            found.setdefault(tuple(w[p : p + k]), set()).add("null" if item is None else str(item))
    sizes, out = {len(k) for k in found}, []
    for doc_id, text in rows:
        w, hit, its = plain_words(text), set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                if (which := found.get(tuple(w[p : p + k]))) is not None:
                    hit |= set(range(p, p + k))
                    its |= which
        out.append((doc_id, len(w), len(hit), len(its), sha(",".join(sorted(its))), bool(hit)))
    return out


ITEM_COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def leaking_texts(seed=6, n=150):
    rng = random.Random(seed)
    vocabulary = ["Ab", "bc", "CD1", "é", "Éa", "x", "yz", "q_r", "don't", "日本"] + [f"w{i}" for i in range(30)]
    prose = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(k))
    items = [(rng.choice([*range(12), None]), rng.choice([None, "", " .,", prose(rng.randint(1, 9)) if rng.random() < 0.1 else prose(10), prose(40), prose(25)])) for _ in range(30)]
    texts = [None, "", "...", "\x00\x7f`@"]
    for _ in range(n):
        t = prose(rng.randint(0, 40))
        if rng.random() < 0.6:
            w = re.split(r"([ ,\n-]+)", rng.choice([x for _, x in items if x]))
            t += " ".join(w[: rng.randint(1, len(w))]).upper() + " " + prose(rng.randint(0, 20))
        texts.append(t)
    return texts, items


@pytest.mark.parametrize("window", [10, 3])
def test_decontamination_against_all_windows(spark, window):
    texts, items = leaking_texts()
    rows = [*enumerate(texts), (None, texts[9]), (7, texts[9]), (7, texts[9])]
    docs = spark.createDataFrame([(i, t, None, "x", 1, 2, "y", 3, "z") for i, t in rows], COLUMNS).repartition(3)
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, size int, shard int")
    got = [tuple(r[c] for c in ITEM_COLUMNS) for r in decontaminate.digest(decontaminate.contamination(docs, table, window)).collect()]
    assert sorted(got, key=repr) == sorted(plain_contamination(rows, items, window), key=repr)
    assert 10 < sum(r[5] for r in got) < len(got)


def test_many_shards_and_pieces_give_the_same_rows(spark, monkeypatch):
    texts, items = leaking_texts(seed=9)
    items.append((99, " ".join(f"w{i % 30} v{i}" for i in range(300))))
    texts += [" ".join(f"w{i % 30} v{i}" for i in range(a, a + 40)) for a in (0, 57, 133, 260)]
    rows = [*enumerate(texts), (None, texts[9]), (7, texts[9]), (7, texts[9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "SHARD", 6000)
    monkeypatch.setattr(decontaminate, "PIECE", 50)
    dealt, count = decontaminate.shards(table)
    assert count > 1 and dealt.groupBy("shard").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] <= 6000
    got = [tuple(r[c] for c in ITEM_COLUMNS) for r in decontaminate.digest(decontaminate.contamination(docs, table)).collect()]
    assert sorted(got, key=repr) == sorted(plain_contamination(rows, items), key=repr)


def test_longest_matches_of_the_automaton():
    rng = random.Random(1)
    for _ in range(60):
        make = lambda n: [b"%d" % rng.randrange(3) for _ in range(n)]
        items = [make(rng.randint(1, 12)) for _ in range(4)]
        text = make(40)
        has = {tuple(w[a:b]) for w in items for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
        expected = [max([k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in has], default=0) for i in range(len(text))]
        assert [n for _, n in decontaminate.Automaton([("a", w) for w in items]).longest(text)] == expected


def test_clean_removes_spans_and_covered_texts(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Start here: {item.title()}! And it goes on for many, many more words than that was", 5), (2, item, 6), (3, None, 7), (4, "clean text", 8)], "doc_id long, text string, items int")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.items) for r in decontaminate.clean(docs, items).collect()}
    assert got == {1: ("Start here: And it goes on for many, many more words than that was", 5), 3: (None, 7), 4: ("clean text", 8)}


def test_decontamination_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(docs.where("false"), items).count() == 0
    assert decontaminate.digest(decontaminate.contamination(docs, items.where("false"))).first().contaminated is False
    assert decontaminate.digest(decontaminate.contamination(docs, items)).first().n_hit == 3


def test_decontamination_sql_on_the_tables(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()["op13_decontamination"])
    assert want.columns == ITEM_COLUMNS
    got = {tuple(r[c] for c in ITEM_COLUMNS) for r in queries.op13_decontamination(spark, SF).collect()}
    assert got == set(want.fetchall())
    assert any(r[5] for r in got)


# Whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, component int"


def plain_whitening(rows, k=4):
    """(per row of integers, e, vectors, n, S) by numpy's own eigenvectors over different rows."""
    x = [(i, [int(np.floor(256 * np.float64(np.float32(c)))) for c in v]) for i, v in rows]
    fit = np.asarray(sorted({tuple(v) for _, v in x}), dtype=np.int64)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    e, q = np.linalg.eigh(y.T @ y / n)
    return x, e[::-1], q[:, ::-1].T[:k], n, s


def vectors(n=400, d=9, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, d)) * np.linspace(3, 0.2, d) + 5
    v[n // 2 :] = v[: n - n // 2]  # each twice
    return [(i, [float(c) for c in row]) for i, row in enumerate(v)]


def test_whitening_against_numpy(spark):
    rows = vectors()
    odd = [(900, None), (901, [1.0, None] + [0.0] * 7), (902, [float("nan")] * 9), (903, [float("-inf")] + [0.0] * 8), (904, [1.0]), (905, [])]
    again = [(None, rows[5][1]), (7, rows[7][1])]
    table = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows + odd + again], VECTORS).repartition(3)
    got = whitening.whiten(table).collect()
    x, e, q, n, s = plain_whitening(rows + again)
    assert len(got) == 4 * len(x) and {r.n for r in got} == {n} and n == 200
    by = {(r.vec_id, r.component): r for r in got}
    first = np.asarray([v for i, v in x[: len(rows)]])
    for c in range(4):
        mine = np.asarray([by[i, c + 1].whitened for i, _ in rows])
        plain = (first - s / n) @ q[c] / np.sqrt(e[c])
        assert min(np.abs(mine - plain).max(), np.abs(mine + plain).max()) < 1e-9
        assert abs(by[0, c + 1].explained / (e[c] / e.sum()) - 1) < 1e-12
    assert all(r.deviation == sum((n * a - int(b)) ** 2 for a, b in zip(dict(x)[r.vec_id], s, strict=True)) for r in got)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_query_over_its_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op11_whitening(spark, SF).collect()
    x, e, q, n, s = plain_whitening(rows)
    assert len(got) == 4 * len(x) and got[0].n == n
    assert max(abs(r.explained / (e[r.component - 1] / e.sum()) - 1) for r in got) < 1e-9
    mine = {(r.vec_id, r.component): r.whitened for r in got}
    for c in range(4):
        plain = {i: (np.asarray(v) - s / n) @ q[c] / np.sqrt(e[c]) for i, v in x}
        assert max(abs(abs(mine[i, c + 1]) - abs(p)) for i, p in plain.items()) < 1e-9


@pytest.mark.parametrize(("rows", "components"), [([], 0), ([(1, None)], 0), ([(1, [2.0, 3.0])] * 3, 0), ([(1, [])], 0), ([(1, [0.0, 1.0]), (2, [1.0, 0.0])], 1), ([(1, [0.0]), (2, [3.0])], 1), ([(i, [float(i), float(i * i % 7), 1.0]) for i in range(9)], 2)])
def test_whitening_of_few_vectors(spark, rows, components):
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == components * len(rows)
    assert all(r.identity_error < 1e-9 for r in got)


def test_deviations_stay_exact():
    x = np.asarray([[3, -4], [2**40, 1]], dtype=np.int64)
    sums = [2**45 + 1, -7]
    assert whitening.deviations(x, 10, sums) == [v if (v := sum((10 * int(a) - b) ** 2 for a, b in zip(row, sums, strict=True))) < 2**63 else None for row in x]
    assert whitening.deviations(x[:1], 10, [1, 2]) == [29**2 + 42**2]


def test_huge_entries_do_not_end_the_job(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.deviation for r in got if r.vec_id != 3} == {None}


def test_inertia_counts_and_certified_numbers():
    rng = np.random.default_rng(0)
    for spectrum in ([5, 5, 5, 5, 1], [5, 5, 1, 1, 1, 0], [3, 2, 2, 2, 2], [1, 1 - 1e-13, 1 - 2e-13, 0.5], [9, 1e-3, 1e-6, 1e-9, 0], [4, 3, 2, 1, 0.5, 0.1]):
        q = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))[0]
        v = q @ np.diag(spectrum).astype(float) @ q.T
        for shift in rng.uniform(-1, 10, 30):
            assert whitening.above(v, shift) == (np.asarray(spectrum) > shift).sum()
        top = whitening.leading(v)
        assert np.allclose(top.values, spectrum[: len(top.values)], rtol=1e-6, atol=1e-13) and len(top.values) == min(4, sum(s > 1e-12 for s in spectrum))
        assert np.abs(top.vectors @ v - top.values[:, None] * top.vectors).max() < 1e-13 * 20
        assert np.abs(top.vectors @ top.vectors.T - np.eye(len(top.values))).max() < 1e-13
