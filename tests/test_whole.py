"""Operators that read whole tables, by brute force on small fixtures."""

import datetime

from quorumlake import catalog
from quorumlake.operators import quality, resolve

DAY = datetime.date(2020, 1, 1)


def test_monotonic_series_are_checked_whole(spark):
    rows = [(k, k % 2, "ordinaria" if k % 3 else None, str(k % 7 + 1) if k % 11 else None, DAY + datetime.timedelta(k * 37 % 50) if k % 13 else None) for k in range(60)]
    d = spark.createDataFrame(rows, "id long, agencia_id long, serie string, numero_reuniao string, data_reuniao date")
    got = sorted(r["id"] for r in quality.monotonic_findings(d).collect())
    full = [(k, a, s or "", int(n), t) for k, a, s, n, t in rows if n and t]
    want = [k for k, a, s, n, t in full if any((a, s) == (b, z) and ((m < n and u > t) or (m > n and u < t)) for _, b, z, m, u in full)]
    assert got == want and want


def test_monotonic_query_is_not_empty(spark):
    found = catalog.queries()["dq_serie_monotonica"](spark, "/root/testdata/sf0.001")
    assert found.where("id % 40 <> 7").count() > 0


def test_votes_of_all_decisions(spark):
    q = catalog.queries()
    for name, key, n in (("construir_votos", "deliberacao_id", 6), ("revoto", "id", 4)):
        assert {r[0] % n for r in q[name](spark, "/root/testdata/sf0.001").select(key).distinct().collect()} >= set(range(n)) - {0}
    built = q["construir_votos"](spark, "/root/testdata/sf0.001").count()
    assert sum(r["n"] for r in q["votos_por_proveniencia"](spark, "/root/testdata/sf0.001").collect()) == built


def test_close_pairs_by_brute_force(spark):
    import random

    def distance(x, y):
        row = list(range(len(y) + 1))
        for k, c in enumerate(x, 1):
            new = [k]
            for j, d in enumerate(y, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab ") for _ in range(rnd.randrange(1, 30))) for _ in range(40)]
    for _ in range(60):
        t = list(rnd.choice(texts))
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(t) + 1)
            t[at : at + rnd.randrange(2)] = rnd.choice(["", "a", "b", "ab"])
        texts.append("".join(t))
    rows = [(k % 3, k, t) for k, t in enumerate(texts)] + [(0, 1000, None)]
    df = spark.createDataFrame(rows, "block int, id int, t string")
    for least in (0.95, 0.8):
        got = {(r["a"], r["b"]): round(r["score"], 9) for r in resolve.close_pairs(df, least).collect()}
        want = {}
        for i, (p, a, x) in enumerate(rows[:-1]):
            for q, b, y in rows[i + 1 : -1]:
                if p == q and (x == y or (x and y and 1 - distance(x, y) / max(len(x), len(y)) >= least)):
                    want[a, b] = 1.0 if x == y else round(1 - distance(x, y) / max(len(x), len(y)), 9)
        assert got == want and want


def _boards(spark):
    """Terms that overlap, touch, are open or in leave, and by brute force who is in office on a day."""
    import random

    rnd = random.Random(5)
    day = lambda n: None if n is None else DAY + datetime.timedelta(n)
    some = lambda a, b: rnd.choice([None, rnd.randrange(a, b)])
    terms = [(k % 9, k % 2, rnd.randrange(30) if k % 11 else None, some(0, 60), some(0, 40), some(0, 60)) for k in range(60)]
    m = spark.createDataFrame([(d, a, *map(day, x)) for d, a, *x in terms], "diretor_id long, agencia_id long, data_inicio date, data_fim date, afastado_desde date, afastado_ate date")

    def office(agency, n):
        return {
            d for d, a, first, last, away, back in terms
            if a == agency and n is not None and first is not None and first <= n and (last is None or last >= n) and not (away is not None and away <= n and (back is None or back >= n))
        }

    return m, day, office


def test_boards_are_counted_without_their_pairs(spark):
    from pyspark.sql import functions as F

    from quorumlake.operators import roster

    m, day, office = _boards(spark)
    asked = [(k, k % 3, k % 70 if k % 8 else None) for k in range(140)]
    votes = [(k, d) for k in range(140) for d in range(k % 5, 9, 3)]
    decisions = spark.createDataFrame([(k, a, day(n)) for k, a, n in asked], "id long, agencia_id long, data_reuniao date")
    got = roster.attendance(decisions, spark.createDataFrame(votes, "id long, diretor_id long"), m, F.count_if(~F.col("sentado")).alias("fora"))
    want = set()
    for k, a, n in asked:
        seats, voted = office(a, n), {d for i, d in votes if i == k}
        want.add((k, len(seats), len(voted), len(seats & voted), len(voted - seats)))
    assert {(r["id"], r["cadeiras"], r["presentes"], r["sentados"], r["fora"]) for r in got.collect()} == want
    pairs = sorted((r["id"], r["diretor_id"]) for r in roster.with_boards(decisions, m).collect())
    assert pairs == sorted((k, d) for k, a, n in asked for d in office(a, n)) and pairs


def test_no_query_of_counts_joins_decisions_with_boards(spark):
    """A join of terms of office with days alone gives a row for each seat."""
    sf = "/root/testdata/sf0.001"
    for name in ("votos_por_proveniencia", "votos_por_proveniencia_inteiro", "completar_colegiado", "revoto", "revoto_inteiro", "presenca_divergente", "veredito_roster"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        joins = [x for x in plan.splitlines() if " Join " in x or x.lstrip("+-: ").startswith("Join")]
        assert joins and not [x for x in joins if "primeiro" in x and "diretor_id" not in x] and not [x for x in joins if "data_inicio" in x], name


def test_like_names_are_compared_once(spark):
    """Common beginnings and many copies of a name made every two names of an agency meet."""
    names = [f"filho supplier#{k:09d}" for k in range(300)] * 4
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(names)], "block int, id int, t string")
    near = lambda x, y: sum(a != b for a, b in zip(x, y)) <= 1
    close = [(a, b) for a in range(300) for b in range(300) if near(names[a], names[b])]
    want = {(i, j) for a, b in close for i in range(a, 1200, 300) for j in range(b, 1200, 300) if i < j}
    out = resolve.close_pairs(df, 0.95)
    got = [(r["a"], r["b"]) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    # what the join of candidates gave, before they were measured
    texts = df.selectExpr("block", "t", "length(t) n").distinct()
    assert resolve._one_edit(texts).distinct().count() < 300 * 40


def test_abbreviations_are_compared_by_name(spark):
    from quorumlake.operators import audit

    short = [(a, k, x) for a in (1, 2) for k, x in enumerate(["Ana Souza", "Ana Souza", "Rui", "Ana Lima", "Eva da Reis", "de", None])]
    long = [(a, 10 + k, y) for a in (1, 2) for k, y in enumerate(["Ana de Lima Souza", "ANA Lima Souza", "Rui Sá", "Eva Maria Reis", "Bia Ana Souza", ""])]
    df = lambda rows, i, c: spark.createDataFrame(rows, f"agencia_id int, {i} int, {c} string")
    got = sorted(map(tuple, audit.abbreviation_pairs(df(short, "a", "x"), df(long, "b", "y")).collect()))
    assert got == sorted(2 * [(0, 10), (0, 11), (1, 10), (1, 11), (3, 10), (3, 11), (4, 13)])
