"""Stored functions in SQL, batch title search, the page directory and written state versions."""

import re
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from marquee.functions.sql import create_functions
from marquee.operators import documents as DOC
from marquee.operators.analytics import avg_rating
from marquee.operators.titlesearch import show_search_batch
from marquee.plans import pagedir as PD
from marquee.session import scratch_dir
from marquee.sources import sinks as SK
from marquee.sources.schemas import TABLES


def test_sql_functions(spark, seed):
    create_functions(seed)
    cost = {r[0]: r[1] for r in spark.sql("SELECT booking_id, fn_total_booking_cost(booking_id) FROM bookings").collect()}
    assert cost == {r.booking_id: r.total_cost for r in DOC.booking_cost(seed).collect()} and len(cost) > 3
    rating = {r[0]: r[1] for r in spark.sql("SELECT show_id, fn_get_event_rating(show_id) FROM shows").collect()}
    assert rating == {r.show_id: r.avg_rating for r in avg_rating(seed).collect()}
    free = {r.seat_id: r.is_available for r in seed["seats"].collect()}
    spark.range(0, 400).withColumnRenamed("id", "seat_id").createOrReplaceTempView("asked")
    assert {r[0]: r[1] for r in spark.sql("SELECT seat_id, fn_is_seat_available(seat_id) FROM asked").collect()} == {s: free.get(s, 0) for s in range(400)}
    assert spark.sql("SELECT fn_total_booking_cost(-1), fn_is_seat_available(-1), fn_get_event_rating(-1)").first()[:] == (D("0.00"), 0, D("0.00"))


def test_sql_functions_are_planned_as_joins(spark, seed):
    create_functions(seed)
    plan = spark.sql("SELECT booking_id, fn_total_booking_cost(booking_id), fn_get_event_rating(show_id) FROM bookings")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


TITLES = ["The Ring", "ring of fire", "Bring it on", "RÍNG", "100% proof", "a_b", "ab", "x", "", None, "under_score 50%", "back\\slash", "ringring"]
PATTERNS = ["ring", "RING", "in", "r", "r_ng", "r%g", "%", "_", "__", "100\\%", "a\\_b", "a_b", "xyz", "", None, "ring%ring", "í", "THE R", "50\\%"]


def like(pattern, title):
    out, k = "", 0
    pattern = f"%{pattern}%"
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
            out += re.escape(pattern[k])
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        k += 1
    return re.fullmatch(out.lower(), title.lower(), re.S) is not None


def test_show_search_batch(spark):
    shows = spark.createDataFrame(list(enumerate(TITLES)), "show_id long, title string")
    asked = spark.createDataFrame(list(enumerate(PATTERNS)), "pattern_id long, pattern string")
    got = {(r.pattern_id, r.show_id) for r in show_search_batch({"shows": shows}, asked).collect()}
    assert got == {(p, s) for p, pattern in enumerate(PATTERNS) for s, title in enumerate(TITLES) if pattern and title is not None and like(pattern, title)}
    assert show_search_batch({"shows": shows}, asked.limit(0)).collect() == []
    assert show_search_batch({"shows": shows.limit(0)}, asked).collect() == []
    plan = show_search_batch({"shows": shows}, asked)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_show_search_batch_gives_every_pair_of_copies(spark, monkeypatch, tmp_path):
    from marquee import catalog
    from marquee.operators import titlesearch as TI

    monkeypatch.setattr(TI, "BLOCK", 2)  # copies go over several blocks
    shows = [(1, "Ring"), (2, "Ring"), (2, "Ring"), (3, "ring"), (None, "Ring"), (4, "King"), (5, None)]
    asked = [(1, "in"), (2, "in"), (2, "in"), (None, "in"), (3, "R"), (4, "zz"), (5, None)]
    found = show_search_batch({"shows": spark.createDataFrame(shows, "show_id long, title string")}, spark.createDataFrame(asked, "pattern_id long, pattern string"))
    want = [(p, s, title) for p, pattern in asked for s, title in shows if pattern and title and like(pattern, title)]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key) and len(want) == 4 * 6 + 5
    part = [(k, "blue ring", "B", "SMALL", 1, 1.0) for k in range(60)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    for name, schema in (("orders", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
                         ("customer", "c_custkey long, c_name string"), ("nation", "n_nationkey long, n_name string, n_regionkey long"), ("region", "r_regionkey long, r_name string"),
                         ("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"), ("supplier", "s_suppkey long, s_name string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    pairs = catalog.queries()["show_search_batch"](spark, str(tmp_path))  # the registered query: a row per pattern and show
    assert pairs.columns == ["pattern_id", "show_id", "title"]
    per = {r[0]: r[1] for r in pairs.groupBy("pattern_id").count().collect()}
    assert set(per.values()) == {60} and len(per) > 20 and 4 not in per


@pytest.mark.parametrize("order,reverse", [(["k"], False), (["-g", "-k"], True)])
def test_page_directory(spark, order, reverse):
    rows = [(k, k % 7) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, g long").repartition(5)
    root = PD.build(df, order, partitions=6)
    want = sorted(rows, key=(lambda r: (r[1], r[0])) if reverse else (lambda r: r[0]), reverse=reverse)
    for n in (1, 2, 17, 50, 51, "x", 10**6):
        first = (n - 1) * 10 if isinstance(n, int) else 0
        assert [(r.k, r.g) for r in PD.page(spark, root, order, n, 10).collect()] == want[first:first + 10]
    d = PD.directory(spark, root).orderBy("before").collect()
    assert sum(r.size for r in d) == 500 and [r.before for r in d] == [sum(x.size for x in d[:i]) for i in range(len(d))]
    assert all(tuple(r.first_key) == tuple(dict(zip("kg", want[r.before]))[c.lstrip("-")] for c in order) for r in d)
    deep = PD.page(spark, root, order, 40, 10)
    files = {f.split("_part=")[1].split("/")[0] for f in deep.inputFiles()}
    assert len(files) == 6 or len(files) <= 2  # inputFiles lists the source; the plan prunes it
    assert "PartitionFilters: [isnotnull(_part" in deep._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [_part" in deep._jdf.queryExecution().executedPlan().toString()
    assert PD.page(spark, PD.build(df.limit(0), order), order, 1).collect() == []


def test_state_versions_are_written_beside_each_other(spark, seed):
    root, tables = scratch_dir(spark, "state"), ["bookings", "seats"]
    SK.write_state(seed, root, 0, tables)
    back = SK.read_state(spark, root, 0, tables)
    assert back["seats"].schema == TABLES["seats"] or back["seats"].columns == [f.name for f in TABLES["seats"].fields]
    SK.write_state({**back, "bookings": back["bookings"].withColumn("booking_status", F.lit("CANCELLED"))}, root, 1, ["bookings"])
    assert {r[0] for r in SK.read_state(spark, root, 1, ["bookings"])["bookings"].select("booking_status").distinct().collect()} == {"CANCELLED"}
    assert sorted(map(tuple, SK.read_state(spark, root, 0, tables)["bookings"].collect())) == sorted(map(tuple, seed["bookings"].collect()))
    with pytest.raises(Exception, match="(?i)exists"):
        SK.write_state(seed, root, 0, tables)
