"""Hash trees, periodic runs and mixes against brute force, with odd rows in every table."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tapeline.llm import merkle, mixing, periodic
from tapeline.llm import queries as Q
from tests.llm.test_operators import ODD, VOCAB, frame, same, words

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = [(i, words(rng, rng.randint(1, 90), VOCAB).replace(" ba", "\nba"), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "a", "b", "é", None])) for i in range(130)]
    periods = [(200 + q, " ".join((VOCAB[:q] * 40)[: 7 * q + 3]), "en", "runs") for q in range(1, 12)]
    return [*out, out[5], (out[5][0], "another text of the same id", "en", out[5][3]), *periods, (300, "lone", "en", "lone"), (301, "\n \n", "en", "blank"), *ODD]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).persist()


# ---------------------------------------------------------------- 11


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, at):
    """(digests before, digests after) by level."""
    out = []
    for nodes in tree[:-1]:
        a = at - at % 3
        out.append((nodes[a:at], nodes[at + 1 : a + 3]))
        at //= 3
    return out


def brute_manifest(rows):
    byte = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    hashed = lambda r, text: H(*map(byte, (r[0], r[3], r[2], len(r[1] or ""), text)))
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r, hashed(r, r[1])))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[g] = levels([leaf for _, leaf in groups[g]])
    over, out = levels([trees[g][-1][0] for g in order]), []
    for k, g in enumerate(order):
        for at, (r, leaf) in enumerate(groups[g]):
            steps = path(trees[g], at) + path(over, k)
            shown = hashed(r, r[1].replace("\n", "")) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None else leaf
            for before, after in steps:
                shown = H(*before, shown, *after)
            out.append((r[0], leaf, trees[g][-1][0], over[-1][0], H(*[x for s in steps for y in s for x in y]), shown, shown == over[-1][0]))
    return out


def digest(docs):
    return merkle.digest(docs, F.when(Q.fold(2) == 0, F.translate("text", "\n", "")))


def test_manifest(docs, rows):
    got = [tuple(r) for r in digest(docs).collect()]
    same(got, brute_manifest(rows))
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_manifest_of_n_rows(spark, n):
    rows = [(i, f"text\n{i}", "en", "s") for i in range(n)]
    same([tuple(r) for r in digest(frame(spark, rows)).collect()], brute_manifest(rows))


def test_manifest_of_nothing(docs):
    assert digest(docs.limit(0)).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert digest(docs.limit(0)).count() == 0


def test_no_window_of_the_tree_holds_a_group(spark):
    nodes = spark.range(100).select(F.lit(0).cast("long").alias("grp"), F.col("id").alias("at"), F.lit(100).cast("long").alias("n"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest"))
    plan = merkle.level(nodes)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    tops, proofs = merkle.tree(nodes, spark.createDataFrame([(100,)], "n long"))
    top = tops.first().top
    assert proofs.select(merkle.fold(F.col("digest"), F.col("proof"))).distinct().collect() == [(top,)]
    assert proofs.select(F.max(F.size("proof"))).first()[0] == 5


# ---------------------------------------------------------------- 12


def brute_runs(ws):
    found = {}
    for q in range(1, len(ws)):
        i = 0
        while i + q < len(ws):
            a = i
            while i + q < len(ws) and ws[i] == ws[i + q]:
                i += 1
            if i - a + q >= max(6, 4 * q) and i > a:
                found.setdefault((a, i - a + q), q)  # a longer period of the same stretch is a multiple
            i += 1
    return sorted((a, n, q) for (a, n), q in found.items())


def test_runs_are_all_there_are():
    rng, seen = random.Random(3), 0
    for _ in range(4000):
        ws = [rng.randint(0, rng.choice([0, 1, 2, 4])) for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            if ws:
                a, p = rng.randrange(len(ws)), rng.randint(1, 7)
                ws = [*ws[:a], *[ws[min(len(ws) - 1, a + i % p)] for i in range(len(ws) - a)]]
        seen += len(brute_runs(ws))
        assert periodic.find_runs(ws) == brute_runs(ws), ws
    assert seen > 1000


def test_runs_of_long_texts():
    rng = random.Random(5)
    for n, p in ((60_000, 1), (60_000, 2_000), (60_000, 14_999)):
        ws = [str(rng.randrange(10**9)) for _ in range(p)]
        assert periodic.find_runs(["x", *[ws[i % p] for i in range(n)], "y"]) == [(1, n, p)]


def brute_periodic(rows):
    out = []
    for i, text, *_ in rows:
        ws = (text or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(ws)
        if i is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            ws = [ws[j] if j < a else ws[a + (j - a) % p] for j in range(n)]
        runs = brute_runs(ws)
        gone = {x for a, m, q in runs for x in range(a + q, a + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        listed = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
        rest = b" ".join(w for j, w in enumerate(ws) if j not in gone)
        out.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, H(listed), hashlib.sha256(rest).hexdigest()))
    return out


def test_periodic(docs, rows):
    got = [tuple(r) for r in periodic.digest(docs).collect()]
    same(got, brute_periodic(rows))
    assert sum(r[1] > 0 for r in got) > 15
    empty = periodic.digest(docs.limit(0))
    assert empty.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert empty.count() == 0


def test_periodic_returns_texts(docs):
    r = periodic.periodic(docs).filter("doc_id = 203").first()
    assert [tuple(x) for x in r.runs] == [(0, 24, 3)]
    assert r.rest == " ".join(VOCAB[:3]).encode()


# ---------------------------------------------------------------- 13


def brute_mix(rows):
    size = lambda t: len((t or "").encode().split())
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    order = sorted(groups, key=lambda x: (x is None, (x or "").encode()))
    totals = {g: sum(size(r[1]) for r in groups[g]) for g in order}
    weight, stopped = {g: k % 3 + 1 for k, g in enumerate(order)}, set()
    while True:
        room = sum(totals.values()) - sum(3 * totals[g] for g in stopped)
        share = room / sum(weight[g] for g in order if g not in stopped)
        above = {g for g in order if g not in stopped and weight[g] * share > 3 * totals[g]}
        if not above:
            break
        stopped |= above
    out = []
    for g in order:
        target = float(3 * totals[g]) if g in stopped else weight[g] * share
        x = target / totals[g] if totals[g] else 0.0
        copies, p = int(x), x - int(x)
        left, slack = target - copies * totals[g], target * mixing.NEAR

        def key(r, p=p):
            u = (int(hashlib.md5(f"1:{'-' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return u / (1 - u) * ((1 - p) / p), (r[0] is not None, r[0] or 0), size(r[1])

        drawn = sorted((r for r in groups[g] if p > 0 and size(r[1])), key=key) if p > 0 else []
        rest = [r for r in groups[g] if not (p > 0 and size(r[1]))]
        for r in drawn:
            takes = size(r[1]) <= left and left > slack
            left -= size(r[1]) * takes
            out.append((r[0], size(r[1]), totals[g], target, (copies + takes) * size(r[1])))
        out += [(r[0], size(r[1]), totals[g], target, copies * size(r[1])) for r in rest]
    return out


def mixed(docs, **more):
    return mixing.mix(docs, F.col("rank") % 3 + 1, **more)


def test_mix(docs, rows, monkeypatch):
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    want = [(*r[:3], round(r[3], 6), r[4]) for r in brute_mix(rows)]
    got = lambda: [(*r[:3], round(r[3], 6), r[4]) for r in mixed(docs).select(cols).collect()]
    first = got()
    same(first, want)
    assert all(r[4] <= 3 * r[1] for r in first)
    monkeypatch.setattr(mixing, "ROWS_A_RANGE", 7)
    monkeypatch.setattr(mixing, "LEAST_BLOCK", 3)
    same(got(), want)
    assert mixed(docs.limit(0)).select(cols).count() == 0


def test_targets_are_met(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 30, 200])), "en", "abcdefgh"[min(7, int(rng.expovariate(0.6)))]) for i in range(1500)]
    found = mixed(frame(spark, rows)).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("longest")).collect()
    assert len(found) == 8
    assert sum(r.target for r in found) == pytest.approx(sum(r.source_size for r in set(found)))
    for r in found:
        assert r.target <= 3 * r.source_size
        assert abs(r.taken - r.target) <= max(1, 0.01 * r.target), r


def test_favoured_documents_are_taken_more_often(spark):
    rows = [(i, " ".join(["w"] * 20), "en", "ab"[i % 7 == 0]) for i in range(2100)]
    got = mixing.mix(frame(spark, rows), 3 - 2 * F.col("rank"), favour=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    by = {(r.source_size, r.even): r for r in got.groupBy("source_size", (F.col("doc_id") % 2 == 0).alias("even")).agg(F.avg("copies").alias("copies"), F.max("copies").alias("most"), F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    for total in {k[0] for k in by}:
        even, odd = by[total, True], by[total, False]
        assert even.copies > odd.copies
        assert even.most <= 3
        assert abs(even.taken + odd.taken - even.target) <= 20
    large = max(k[0] for k in by)
    assert by[large, True].copies / by[large, False].copies == pytest.approx(3, rel=0.15)


def test_without_words(spark):
    rows = [(1, "", "en", "a"), (2, None, "en", None)]
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixed(frame(spark, rows)).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_mix_plan_is_native(docs):
    plan = mixed(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("name", ["op11_merkle", "op12_periodic", "op13_mixing"])
def test_registered(spark, rows, tmp_path, name):
    """The registered queries over a folder, against brute force and their SQL."""
    import duckdb

    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    df = Q.queries()[name](spark, str(tmp_path))
    neat = lambda rows: [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows]
    got = neat(df.collect())
    same(got, neat({"op11_merkle": brute_manifest, "op12_periodic": brute_periodic, "op13_mixing": brute_mix}[name](rows)))
    if sql := Q.oracle_sql().get(name):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        found = con.execute(sql)
        at = [[c[0] for c in found.description].index(x) for x in df.columns]
        same(got, neat([tuple(r[k] for k in at) for r in found.fetchall()]))
