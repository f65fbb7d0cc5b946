"""Semantics that the tables don't show: nulls, empty values, errors, files and versions."""

import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import catalog
from tessera.functions import arrays, expr, jsonfns, net, ranges, udf
from tessera.operators import dml, windows
from tessera.plans.query import Query
from tessera.sources import copy
from tessera.streaming import changes


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def ints(*values):
    return F.array(*[F.lit(v).cast("int") for v in values]) if values else F.array().cast("array<int>")


def test_null_logic(spark):
    null = F.lit(None).cast("int")
    assert one(spark, expr.is_in(null, [])) is False and one(spark, expr.not_in(null, [])) is True
    assert one(spark, expr.eq_any(F.lit(1), [2, None])) is None and one(spark, expr.ne_all(F.lit(1), [2, None])) is None
    assert one(spark, expr.distinct_from(null, null)) is False and one(spark, expr.distinct_from(null, F.lit(1))) is True


@pytest.mark.parametrize(("text", "pattern", "fits"), [("abc", "a%", True), ("abc", "b%", False), ("abc", "(a|x)bc", True), ("a.c", "a.c", True), ("abc", "a.c", False), ("a%", "a\\%", True), ("ab", "a\\%", False), ("a\nb", "a%b", True)])
def test_similar_to(spark, text, pattern, fits):
    assert one(spark, expr.similar_to(F.lit(text), pattern)) is fits


def test_arrays_with_nulls_and_empty_ones(spark):
    none = F.lit(None).cast("array<int>")
    assert one(spark, arrays.overlaps(ints(1, None), ints(None, 2))) is False
    assert one(spark, arrays.contains(ints(1, None), ints(None))) is False and one(spark, arrays.contains(ints(1), ints())) is True
    assert one(spark, arrays.concat(none, ints(1))) == [1] and one(spark, arrays.concat(none, none)) is None
    assert one(spark, arrays.append(none, F.lit(3))) == [3] and one(spark, arrays.prepend(F.lit(3), none)) == [3]
    assert one(spark, arrays.positions(ints(), F.lit(1))) == [] and one(spark, arrays.position(ints(2), F.lit(1))) is None
    assert one(spark, arrays.remove(ints(1, None, 2), F.lit(None))) == [1, 2]
    assert one(spark, arrays.length(ints())) is None and one(spark, arrays.dims(ints())) is None and one(spark, arrays.cardinality(ints())) == 0
    assert one(spark, arrays.fill(F.lit(1), 2, 3)) == [[1, 1, 1], [1, 1, 1]] and one(spark, arrays.index(ints(5), 9)) is None
    assert one(spark, arrays.assign_slice(ints(1, 2, 3, 4), 2, ints(8, 9))) == [1, 8, 9, 4]
    with pytest.raises(Exception, match="trim"):
        one(spark, arrays.trim(ints(1), 2))


def test_ranges_at_their_edges(spark):
    r = lambda a, b, k="[)": ranges.int_range(F.lit(a).cast("int"), F.lit(b).cast("int"), k)
    n = lambda a, b, k: ranges.make(F.lit(a).cast("double"), F.lit(b).cast("double"), k)
    assert one(spark, r(3, 5, "[]")).asDict() == {"lower": 3, "upper": 6, "lower_inc": True, "upper_inc": False, "empty": False}
    assert one(spark, ranges.is_empty(r(5, 5))) and not one(spark, ranges.is_empty(n(5, 5, "[]")))
    assert one(spark, ranges.contains(r(None, 5), F.lit(-100))) and not one(spark, ranges.contains(r(None, 5), F.lit(5)))
    assert one(spark, ranges.overlaps(n(1, 2, "[]"), n(2, 3, "[]"))) and not one(spark, ranges.overlaps(n(1, 2, "[)"), n(2, 3, "[]")))
    assert one(spark, ranges.adjacent(n(1, 2, "[)"), n(2, 3, "[]"))) and not one(spark, ranges.adjacent(n(1, 2, "[]"), n(2, 3, "[]")))
    assert one(spark, ranges.merge(r(1, 2), r(None, 0)))["lower"] is None and one(spark, ranges.upper_inf(r(1, None)))
    assert one(spark, ranges.is_empty(ranges.intersection(r(1, 3), r(3, 5)))) and one(spark, ranges.is_empty(ranges.difference(r(1, 3), r(0, 9))))
    assert one(spark, ranges.difference(r(1, 9), r(5, None))).upper == 5
    for wrong in (ranges.union(r(1, 2), r(5, 6)), ranges.difference(r(1, 9), r(3, 4))):
        with pytest.raises(Exception, match="contiguous"):
            one(spark, wrong)


def test_json_writing(spark):
    j = F.lit('{"a": [1, {"b": null}], "c": "x"}')
    assert one(spark, jsonfns.set_at(j, ["a", -1, "b"], "2")) == '{"a":[1,{"b":2}],"c":"x"}'
    assert one(spark, jsonfns.set_at(j, ["z"], "2", create=False)) == one(spark, jsonfns.canonical(j))
    assert one(spark, jsonfns.set_at(j, ["a", 9], "2")) == '{"a":[1,{"b":null},2],"c":"x"}'
    assert one(spark, jsonfns.insert_at(j, ["a", 0], "0")) == '{"a":[0,1,{"b":null}],"c":"x"}'
    assert one(spark, jsonfns.remove(j, "a", 0)) == '{"a":[{"b":null}],"c":"x"}' and one(spark, jsonfns.set_at(F.lit(None).cast("string"), ["a"], "1")) is None
    assert one(spark, jsonfns.contains(j, '{"a": [{"b": null}]}')) and not one(spark, jsonfns.contains(j, '{"a": [2]}'))
    assert one(spark, jsonfns.strip_nulls(j)) == '{"a":[1,{}],"c":"x"}' and one(spark, jsonfns.is_json(F.lit(None).cast("string"))) is None
    with pytest.raises(ValueError, match="null"):
        jsonfns.set_lax(j, ["a"], None, "raise_exception")


def test_networks_of_version_6_and_null(spark):
    assert one(spark, net.network(F.lit("2001:db8::1/32"))) == "2001:db8::/32" and one(spark, net.masklen(F.lit("::1"))) == 128
    assert one(spark, net.host(F.lit(None).cast("string"))) is None and one(spark, net.abbrev(F.lit("10.1.2.3/32"))) == "10.1.2.3"
    assert one(spark, net.contained(F.lit("10.0.0.0/8"), F.lit("10.0.0.0/8"))) is False and one(spark, net.overlaps(F.lit("::1"), F.lit("10.0.0.1"))) is False


def test_query_clauses_replace_or_add(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "id long, g long")
    q = Query(df).filter(F.col("g") == 1).or_filter(F.col("id") == 0).order(F.col("g")).order(F.col("id").desc()).limit(1).limit(2)
    assert [r.id for r in q.run().collect()] == [7, 4] and q.count().first()[0] == 4
    assert [r.id for r in Query(df).order(F.col("g").desc()).then_order_by(F.col("id")).limit(2).run().collect()] == [2, 5]


def test_exclusion_golden_values(spark):
    df = spark.createDataFrame([(1, "Sean"), (2, "Tess")], "id long, name string")
    frame = lambda kind, a, b, e: [r.v for r in windows.excluding(df, [], [F.col("id")], (kind, a, b), e, F.col("id"), windows.array_count, "v").orderBy("id").collect()]
    wide = (windows.UNBOUNDED_PRECEDING, windows.UNBOUNDED_FOLLOWING)
    assert frame("rows", *wide, "current") == [1, 1] and frame("rows", 0, 0, "no others") == [1, 1]
    assert frame("rows", 0, 0, "current") == frame("rows", 0, 0, "group") == [0, 0] and frame("rows", 0, 0, "ties") == [1, 1]


def test_changes_are_published_by_version(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0)], "k long, name string, x double")
    table = catalog.Table("t", ("k",), defaults={"x": 9.0})
    dml.publish(dml.insert(old, spark.createDataFrame([(3,)], "k long"), table), str(tmp_path), 1)
    assert sorted(tuple(r) for r in dml.latest(spark, str(tmp_path)).collect()) == [(1, "a", 1.0), (2, None, 2.0), (3, None, 9.0)]
    (tmp_path / "v000002").mkdir()
    assert dml.latest(spark, str(tmp_path)).count() == 3
    assert dml.update(old, {"x": F.lit(0.0)}, F.col("name") == "a").table.where("x = 0").count() == 1
    kept = dml.update(old, {"x": F.col("x") + 1}, keep_old=True).returning.orderBy("k").collect()
    assert [(r.x, r.old.x) for r in kept] == [(2.0, 1.0), (3.0, 2.0)]
    twice = dml.insert_or_ignore(old, spark.createDataFrame([(5, "b", 1.0), (5, "c", 2.0), (1, "z", 0.0)], old.schema), table)
    assert [tuple(r) for r in twice.returning.collect()] == [(5, "b", 1.0)]
    with pytest.raises(ValueError, match="no changes"):
        dml.update(old, {})


def test_text_copy_round_trip(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.StringType())])
    rows = [(1, "a"), (2, None), (3, "x y"), (None, 'q"r')]
    for name, options in {"text": copy.CopyOptions(), "csv": copy.CopyOptions("csv", delimiter=";", null="NIL", header=True), "binary": copy.CopyOptions("binary")}.items():
        path = str(tmp_path / name)
        copy.copy_to(spark.createDataFrame(rows, schema), path, options)
        assert sorted(map(tuple, copy.copy_from(spark, path, schema, options).collect()), key=repr) == sorted(rows, key=repr)
    spark.createDataFrame([("DEF", "a")], "k string, t string").write.csv(str(tmp_path / "d"))
    got = copy.copy_from(spark, str(tmp_path / "d"), schema, copy.CopyOptions("csv", default="DEF", defaults={"k": 7}))
    assert [tuple(r) for r in got.collect()] == [(7, "a")]


def test_aggregate_of_nothing(spark):
    total = udf.aggregate(lambda: 0.0, lambda s, v: s + v, lambda s: -1.0 if s is None else s, "double")
    assert spark.createDataFrame([(1, 2.0), (1, 3.0)], "g long, x double").groupBy("g").agg(total("x").alias("v")).first().v == 5.0


def test_change_stream(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, what string")
    rows.write.parquet(folder)
    changes.on_change(changes.change_stream(spark, folder, rows.schema), lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "ck")).awaitTermination()
    assert sorted(seen) == [1, 2]


def test_schema_tools(spark):
    a, b = spark.createDataFrame([], "x long, y string"), spark.createDataFrame([], "x string, z long")
    assert catalog.schema_diff(a, b) == {"added": ["z"], "dropped": ["y"], "changed": ["x"]} and catalog.describe(a)[0] == ("x", "bigint", True)


def test_having_replaces(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "k int, v int")
    q = Query(df).group_by("k").aggregate(F.count("*").alias("n")).having(F.col("n") > 5)
    assert [r.k for r in q.having(F.col("n") == 1).run().collect()] == [2]


def test_new_rows_with_one_key(spark):
    table = catalog.Table("t", ("k",))
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "x")], "k int, v string")
    new = spark.createDataFrame([(1, "c"), (1, "d"), (3, "e"), (None, "y"), (None, "z")], "k int, v string")
    got = {(r.k, r.v) for r in dml.replace(old, new, table, order=F.when(F.col("v") == "c", 9).otherwise(1)).table.where("k is not null").collect()}
    assert got == {(1, "c"), (2, "b"), (3, "e")}
    assert {(r.k, r.v) for r in dml.replace(old, new, table).table.where("k is not null").collect()} == {(1, "d"), (2, "b"), (3, "e")}
    with pytest.raises(Exception, match="second time"):
        dml.upsert(old, new, table, {"v": F.col("excluded.v")}).table.collect()
    once = dml.upsert(old, new.where("v <> 'd'"), table, {"v": F.col("excluded.v")})
    assert sorted(((r.k, r.v) for r in once.table.collect()), key=repr) == sorted([(1, "c"), (2, "b"), (3, "e"), (None, "x"), (None, "y"), (None, "z")], key=repr)


@pytest.mark.parametrize("kind", ["rows", "groups", "range"])
@pytest.mark.parametrize("bounds", [(-2, 1), (1, 2), (-3, -1), (0, 0)])
def test_sums_with_exclusions_by_brute_force(spark, kind, bounds):
    r = random.Random(1)
    rows = [(g, o, i, r.choice([None, 1.0, 2.5, 4.0])) for g in range(3) for i, o in enumerate(sorted(r.randrange(6) for _ in range(9)))]
    df = spark.createDataFrame(rows, "g int, o int, i int, v double")
    start, end = bounds
    for exclude in ("current", "group", "ties", "no others"):
        # Rows are told apart by i in their order, except where peers matter.
        order = [F.col("o")] if kind != "rows" else [F.col("o"), F.col("i") * 0]
        got = windows.excluding_sums(df, ["g"], order, (kind, start, end), exclude, F.col("v"), "n", "s")
        place = {}
        if kind == "rows":
            numbered = df.withColumn("p", F.row_number().over(windows.Window.partitionBy("g").orderBy(*order)))
            place = {(x.g, x.i): x.p for x in numbered.collect()}
        for x in got.collect():
            held = []
            for g, o, i, v in rows:
                if g != x.g:
                    continue
                peers = sorted({q for h, q, _, _ in rows if h == g})
                gap = {"rows": lambda: place[g, i] - place[x.g, x.i], "groups": lambda: peers.index(o) - peers.index(x.o), "range": lambda: o - x.o}[kind]()  # noqa: B023
                same, me = o == x.o, i == x.i
                gone = {"current": me, "group": same, "ties": same and not me, "no others": False}[exclude]
                if start <= gap <= end and not gone and v is not None:
                    held.append(v)
            assert (x.n, x.s) == (len(held), sum(held) if held else None), (exclude, x)


def test_keys_and_paths_of_json(spark):
    has = lambda j, k: one(spark, jsonfns.has_key(F.lit(j), k))
    assert has('["a", "b"]', "a") and not has("[1]", "1") and has('"a"', "a") and not has("7", "7") and not has("no json", "a") and has(None, "a") is None
    assert one(spark, jsonfns.has_all_keys(F.lit('["a", "b", 1]'), ["a", "b"])) and not one(spark, jsonfns.has_any_key(F.lit("[1, null]"), ["a"]))
    odd = F.lit('{"a.b": {"c[0]": 1, "it\'s": [2]}}')
    assert one(spark, jsonfns.text_at(odd, "a.b", "c[0]")) == "1" and one(spark, jsonfns.text_at(odd, "a.b", "it's", 0)) == "2" and one(spark, jsonfns.object_at(odd, "a.b", "it's")) == "[2]"
    place = lambda t: one(spark, jsonfns.error_position(F.lit(t)))
    assert place("NaN") == 1 and place('{"a": -Infinity}') == 7 and place('["NaN", 1]') == 0 and place("[1,]") == 4
    edit = lambda f, *changes: one(spark, f(F.lit('{"a":[1,2],"b":{}}'), *changes))
    assert edit(jsonfns.insert_paths, ("$.a[#]", "3"), ("$.a[0]", "9"), ("$.b.c.d", "1"), ("$.b.e", "null")) == '{"a":[1,2,3],"b":{"e":null}}'
    assert edit(jsonfns.replace_paths, ("$.a[#-1]", "9"), ("$.x", "1"), ("$.a[7]", "1")) == '{"a":[1,9],"b":{}}' and edit(jsonfns.set_paths, ("$", "7")) == "7"
    assert edit(jsonfns.remove_paths, "$.a[0]", "$.a[0]", "$.z") == '{"a":[],"b":{}}' and edit(jsonfns.remove_paths, "$") is None
    with pytest.raises(ValueError, match="bad JSON path"):
        jsonfns.set_paths(F.lit("{}"), ("a.b", "1"))
    assert one(spark, jsonfns.object_of_pairs(F.array(F.lit("a"), F.lit(None).cast("string")))) == '{"a":null}' and one(spark, jsonfns.object_of_pairs(F.array().cast("array<string>"))) == "{}"
    with pytest.raises(Exception, match="even number"):
        one(spark, jsonfns.object_of_pairs(F.array(F.lit("a"))))


def test_json_aggregates_keep_nulls(spark):
    df = spark.createDataFrame([(1, 2, "x"), (1, 1, None), (2, 1, None)], "k int, o int, v string")
    got = {r.k: (r.a, r.f, r.m) for r in df.groupBy("k").agg(jsonfns.group_array(F.col("v"), F.col("o")).alias("a"), jsonfns.group_array(F.col("v"), where=F.col("o") > 1).alias("f"), jsonfns.group_object(F.col("v"), F.col("o")).alias("m")).collect()}
    assert got == {1: ('[null,"x"]', '["x"]', '{"x":2}'), 2: ("[null]", "[]", "{}")}


def test_functions_of_users_see_nulls(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "v int")
    assert sorted(r.v for r in df.select(udf.scalar(lambda v: repr(v), "string")("v").alias("v")).collect()) == ["1", "3", "None"]
    assert len({r.v for r in spark.range(5).select(udf.constant(lambda: uuid.uuid4().hex, "string").alias("v")).collect()}) == 5
    total = udf.aggregate_by(df.withColumn("k", F.lit(None).cast("string")).repartition(3), ["k"], F.col("v"), lambda: 0, lambda s, v: s + (v or 0), lambda a, b: a + b, lambda s: s, "bigint", "n")
    assert [(r.k, r.n) for r in total.collect()] == [(None, 4)]


def test_foreign_keys_lead_joins():
    with pytest.raises(ValueError, match="0 foreign keys"):
        catalog.reference("region", "nation")


def test_orphans_and_nulls_are_refused(spark):
    from tessera.plans.query import try_grouped_by

    parents, children = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 1), (2, 9), (3, None)], "c int, parent int")
    with pytest.raises(Exception, match="refers to no parent"):
        try_grouped_by(parents, children, "id", "parent", "kids", "c").collect()
    assert {r.id: len(r.kids) for r in try_grouped_by(parents, children.where("c <> 2"), "id", "parent", "kids", "c").collect()} == {1: 1, 2: 0}
    with pytest.raises(Exception, match="assumed to hold none"):
        parents.select(expr.assume_not_null(F.nullif(F.col("id"), F.lit(2))).alias("v")).collect()


def test_text_copies_escape(spark, tmp_path):
    rows = [(1, "a\tb\nc\\d|"), (2, None), (3, "\\N"), (4, ""), (5, "\\\\|\\t|\\"), (None, "|")]
    df = spark.createDataFrame(rows, "n int, t string")
    for delimiter in (None, "|", ","):
        options = copy.CopyOptions("text", delimiter=delimiter)
        path = str(tmp_path / f"text{delimiter and ord(delimiter)}")
        copy.copy_to(df, path, options)
        assert sorted(map(tuple, copy.copy_from(spark, path, df.schema, options).collect()), key=repr) == sorted(rows, key=repr)


def test_groups_in_any_order(spark):
    from tessera.operators.aggregates import By, ordered_list

    df = spark.createDataFrame([(1, "b"), (None, "a"), (2, "c"), (2, "d")], "o int, v string")
    by = lambda *order: df.agg(ordered_list(F.col("v"), *order).alias("v")).first().v
    assert by(By(F.col("o"), descending=True), By(F.col("v"))) == ["a", "c", "d", "b"] and by(By(F.col("o"), descending=True, nulls_first=False), By(F.col("v"), descending=True)) == ["d", "c", "b", "a"]
    assert by(By(F.col("o")), By(F.col("v"))) == ["b", "c", "d", "a"] and by(By(F.col("o"), nulls_first=True), By(F.col("v"))) == ["a", "b", "c", "d"]


def test_networks_by_the_standard_module(spark):
    import ipaddress

    r = random.Random(2)
    four = [f"{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}/{r.randrange(33)}" for _ in range(60)]
    six = [f"{ipaddress.IPv6Address(r.getrandbits(128) & r.getrandbits(128) & (2**128 - 1 << r.choice([0, 40, 100])))}/{r.randrange(129)}" for _ in range(60)] + ["::/0", "::1", "1::/3", "a:0:0:b::c/70", "::ffff:1.2.3.4/120", "0:0:1::", "1:2:3:4:5:6:7:8/64", "1:2:3:4:5:6:0:0"]
    rows = [(a, r.choice(group if r.random() < 0.9 else four)) for group in (four + ["10.0.0.1", "0.0.0.0/0"], six) for a in group] + [(None, "::1"), ("::1", None)]
    rows += [(a, str(ipaddress.ip_interface(a).network.supernet()) if ipaddress.ip_interface(a).network.prefixlen else a) for a in four + six]
    a, b = F.col("a"), F.col("b")
    table = spark.createDataFrame(rows, "a string, b string").repartition(1).select("a", "b", net.netmask(a).alias("netmask"), net.hostmask(a).alias("hostmask"), net.network(a).alias("network"), net.broadcast(a).alias("broadcast"), net.abbrev(a).alias("abbrev"), net.contained(a, b).alias("contained"), net.contained_or_eq(a, b).alias("or_eq"), net.overlaps(a, b).alias("overlaps"), net.merge(a, b).alias("merge"), net.bit_and(a, b).alias("band"), net.bit_or(a, b).alias("bor"))
    for x in table.collect():
        if x.a is None or x.b is None:
            assert x.contained is None and x.merge is None and x.band is None
            continue
        i, j = ipaddress.ip_interface(x.a), ipaddress.ip_interface(x.b)
        n, m = i.network, j.network
        assert (x.netmask, x.hostmask, x.network, x.broadcast) == (str(n.netmask), str(n.hostmask), str(n), f"{n.broadcast_address}/{n.prefixlen}"), x.a
        assert x.abbrev == (str(i.ip) if n.prefixlen == i.max_prefixlen else f"{i.ip}/{n.prefixlen}")
        same = i.version == j.version
        within = same and n.subnet_of(m)
        assert (x.or_eq, x.contained, x.overlaps) == (within, within and n.prefixlen > m.prefixlen, same and n.overlaps(m)), (x.a, x.b)
        if not same:
            assert x.merge is None and x.band is None and x.bor is None
            continue
        while not m.subnet_of(n):
            n = n.supernet()
        assert x.merge == str(n), (x.a, x.b)
        make = type(i.ip)
        tail = f"/{max(i.network.prefixlen, j.network.prefixlen)}" if i.version == 4 else ""
        assert (x.band, x.bor) == (f"{make(int(i.ip) & int(j.ip))}{tail}", f"{make(int(i.ip) | int(j.ip))}{tail}")


@pytest.mark.parametrize(("gather", "exclude", "kind", "sorts"), [(False, "group", "groups", 2), (False, "ties", "groups", 2), (False, "group", "rows", 2), (False, "ties", "range", 2), (True, "current", "rows", 1)])
def test_frames_with_exclude_are_dealt_to_all_partitions_and_sorted_rarely(spark, capsys, gather, exclude, kind, sorts):
    df = spark.range(400).select((F.col("id") % 40).alias("g"), (F.col("id") % 3).alias("o"), "id")
    if gather:
        got = windows.excluding(df, ["g"], [F.col("o"), F.col("id")], (kind, -1, 1), exclude, F.col("id"), windows.array_count, "n")
    else:
        got = windows.excluding_sums(df, ["g"], [F.col("o")], (kind, -1, 1), exclude, F.col("id"), "n", "s")
    got.explain()
    plan = capsys.readouterr().out
    assert plan.count("Sort [") == sorts and "REPARTITION_BY_NUM" in plan
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() == 4
