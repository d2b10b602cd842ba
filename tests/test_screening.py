"""Names, similarity, blocking, scoring, versions and operations."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lynceus.functions import names as NM
from lynceus.functions import phonetics as PH
from lynceus.operators import blocking as B
from lynceus.operators import operations as OP
from lynceus.operators import scoring as SC
from lynceus.operators import versions as VS
from lynceus.plans import screening
from lynceus.sources import adapters, readers
from lynceus.streaming import rescreen


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "name,norm",
    [("Müller & Söhne Limited", "muller sohne ltd"), ("Al-Sayed", "alsayed"), ("Alsayed", "alsayed"), ("M0hammed", "mohammed"), ("Dr. José  Núñez", "jose nunez"), ("Иван Петров", "ivan petrov"),
     ("O'Brien", "obrien"), ("Straße", "strasse"), (None, ""), ("  ", "")],
)
def test_normalised(spark, name, norm):
    assert one(spark, NM.normalised(F.lit(name).cast("string"))) == norm


def test_ali_is_not_alia(spark):
    a, b = NM.normalised(F.lit("Ali")), NM.normalised(F.lit("Alia"))
    assert one(spark, a) != one(spark, b) and one(spark, NM.edit_ratio(a, b)) == 0.75


def test_string_distances_agree_with_another_engine():
    rng, con = random.Random(1), duckdb.connect()
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        jw, dl = con.execute("select jaro_winkler_similarity(?, ?), damerau_levenshtein(?, ?)", [a, b, a, b]).fetchone()
        assert abs(NM._jaro_winkler(a, b) - jw) < 1e-9 and NM._damerau(a, b) == dl


NAMES = """Smith Schmidt Garcia Rogers Wagner Laugh McLaughlin Bacchus Accident Hochmeier Pizza Filipowicz Knight Psycho Xavier Jose Villa Bough Night
Dumb Michael Character Church Edge Judge Sugar School Island Ghana Gerald Danger McHugh Czerny Nation Thames Caesar Focaccia Tagliaro Raphael Artois
Mohammed Hussein Petrov Kowalski Zhang Nguyen Whale Breaux Rogier Cabrillo""".split()


def test_phonetic_codes_agree_with_the_codec_library(spark):
    codec = spark._jvm.org.apache.commons.codec.language
    other, third = codec.DoubleMetaphone(), codec.Nysiis()
    for n in NAMES:
        assert PH.double_metaphone(n) == (other.doubleMetaphone(n), other.doubleMetaphone(n, True)), n
        assert PH.nysiis(n) == third.nysiis(n), n
    assert PH.double_metaphone("") == ("", "") and PH.nysiis("12") == ""
    row = spark.createDataFrame([(["Smith", "Ghana"],), (None,)], "w array<string>").select(PH.double_metaphone_codes("w")).collect()
    assert row[0][0] == ["KN", "SM0", "XMT"] and row[1][0] is None


def test_prefix_filter_loses_no_pair(spark):
    rng = random.Random(2)
    words = ["the", "of", *[f"w{k}" for k in range(25)]]
    names = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(120)})
    frame = B.name_classes(spark.createDataFrame(list(enumerate(names)), "id long, name string"), "id", "name")
    found = {(r.l, r.r) for r in B.by_token(frame, frame, 0.5).collect()}
    sets = {n: set(n.split()) for n in names}
    assert found == {(a, b) for a, b in itertools.product(names, names) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    grams = {n: {f"  {n} "[k : k + 3] for k in range(len(n) + 1)} for n in names}
    found = {(r.l, r.r) for r in B.by_trigram(frame, frame, 0.7).collect()}
    assert found == {(a, b) for a, b in itertools.product(names, names) if 2 * len(grams[a] & grams[b]) >= 0.7 * (len(grams[a]) + len(grams[b])) - 1e-12}


def test_screen_keeps_and_explains_every_candidate(spark):
    listed = [(1, "Mohammed Al-Sayed"), (2, "Sahara Trading Ltd"), (3, "John Smith"), (4, "John Smith"), (5, None), (6, "")]
    asked = [(1, "M0hammed Alsayed", "INDIVIDUAL"), (2, "SMITH, JOHN", "INDIVIDUAL"), (3, "Nobody Known", "ORGANISATION"), (4, None, None)]
    rows = screening.screen(spark.createDataFrame(asked, "id long, name string, entity_type string"), spark.createDataFrame(listed, "id long, name string"))
    got = rows.withColumn("again", SC.recomputed(F.col("explanation"))).collect()
    assert all(r.score == r.again for r in got)
    best = {r.subject: r for r in got if r["rank"] == 1}
    assert best[1].entity == 1 and best[1].band == "STRONG" and best[2].entity == 3 and best[2].n_entities == 2 and 3 not in best


def test_effects_adjust_and_identifiers_lift(spark):
    rows = [(1, 0.9, "2000-01-01", "2000-01-01", False), (2, 0.9, "2000-01-01", "1990-01-01", False), (3, 0.2, None, "1990-01-01", True), (4, 0.9, "2000-05-01", "2000-01-01", False)]
    frame = spark.createDataFrame(rows, "id long, v double, dob string, listed_dob string, identifier_match boolean").withColumn("entity_type", F.lit("INDIVIDUAL"))
    out = {r.id: (r.score, r.band) for r in SC.scored(frame.withColumns({f: F.col("v") for f in SC.FEATURES})).collect()}
    assert out == {1: (100.0, "STRONG"), 2: (75.0, "POSSIBLE"), 3: (92.0, "STRONG"), 4: (95.0, "STRONG")}
    assert one(spark, SC.band(F.lit(None).cast("double"))) == "ERROR" and one(spark, SC.band(F.lit(99.0), F.lit(False))) == "ERROR"


def test_error_dominates(spark):
    rows = spark.createDataFrame([("a", "STRONG"), ("a", "ERROR"), ("b", "NO_MATCH")], "l string, band string")
    assert {r.l: r.outcome for r in SC.request_outcome(rows, "l").collect()} == {"a": "ERROR", "b": "NO_MATCH"}
    assert {r.outcome for r in screening.outcome(True, rows).collect()} == {"ERROR"}


def test_reload_and_tombstone(spark):
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "id long, name string").withColumn("hash", VS.content_hash("name"))
    again = VS.reconcile(rows, rows, "id").groupBy("change").count().collect()
    assert [(r.change, r["count"]) for r in again] == [("UNCHANGED", 20)]
    assert [r.id for r in VS.tombstones(rows, rows.filter("id <> 7"), "id").collect()] == [7]
    gate = VS.delta_gate(VS.reconcile(rows, rows.filter("id > 5"), "id")).first()
    assert gate.halt and gate.delisted == 6
    assert not VS.delta_gate(VS.reconcile(rows, rows, "id")).first().halt
    assert VS.delta_gate(VS.reconcile(rows.limit(0), rows.limit(0), "id")).first().halt  # nothing to compare with


def test_audit_chain_notices_a_change(spark):
    rows = [("s", k, f"p{k}") for k in range(6)]
    chain = lambda x: [r.chain_hash for r in OP.audit_chain(spark.createDataFrame(x, "stream string, k long, p string"), "stream", ["k"], "p").orderBy("k").collect()]
    a, b = chain(rows), chain([r if r[1] != 3 else ("s", 3, "forged") for r in rows])
    assert a[:3] == b[:3] and not set(a[3:]) & set(b[3:])


def test_readers(spark, tmp_path):
    long = "x" * 120_000
    (tmp_path / "f.xml").write_text(
        f"""<feed xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">
<record uid="007" category="VESSEL" e-i="E"><person><names><last_name>Sea Star</last_name><aliases><alias>A</alias><alias>B</alias></aliases></names><dob xsi:nil="true"/></person><details><further_information> {long} </further_information></details></record>
<record uid="8" category="X" e-i="M"><person><names><first_name>Jo</first_name><last_name>Do</last_name></names><dob>1970</dob></person></record></feed>"""
    )
    feed = readers.read_xml(spark, str(tmp_path / "f.xml"))
    rows = {r.uid: r for r in adapters.feed_to_canonical(feed).collect()}
    assert (rows["007"].PRIMARY_NAME, rows["007"].ENTITY_TYPE, rows["007"].DATE_OF_BIRTH, rows["007"].ALIAS) == ("Sea Star", "VESSEL", None, ["A", "B"])
    assert (rows["8"].PRIMARY_NAME, rows["8"].ENTITY_TYPE, rows["8"].DATE_OF_BIRTH) == ("Jo Do", "INDIVIDUAL", "1970")
    assert [len(r.narrative) for r in readers.narratives(feed).collect()] == [120_000]
    (tmp_path / "f.txt").write_text("007Sea Star \n  8Jo\n")
    fixed = readers.read_fixed_width(spark, str(tmp_path / "f.txt"), [("uid", 1, 3), ("name", 4, 9)])
    assert [tuple(r) for r in fixed.collect()] == [("007", "Sea Star"), ("8", "Jo")]
    assert readers.checksums(spark, str(tmp_path / "f.txt")).first().length == 19
    with pytest.raises(KeyError):
        readers.resolve("pdf")
    with pytest.raises(ValueError):
        adapters.mapped(fixed, [("NO_SLOT", "uid", "TRIM", None)])
    adapters.write_tsv(fixed.withColumn("name", F.lit("a\tb\nc")), str(tmp_path / "out"), ["uid"], 1)
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).collect()[0].name == "a b c"


def test_streams(spark, tmp_path):
    rows = spark.range(20).select(F.timestamp_seconds(F.col("id") * 20000).alias("ts"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    run = lambda: rescreen.rescreen_arrivals(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "at"), lambda df, n: seen.append(df.count())).awaitTermination(60)
    run()
    run()
    assert seen == [20]  # what was read once is not read again
    stream = rescreen.alert_rates(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {tuple(r) for r in spark.table("rates").collect()} == {tuple(r) for r in rescreen.alert_rates(rows).collect()}


def test_other_forms_and_scripts_of_names(spark):
    names = ["Ｊｏｈｎ Smith", "ﬁnance Ⓖroup", "محمد خان", "José Ångström", "x²"]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string").select("id", NM.normalised(F.col("name")).alias("n")).collect()
    assert {r.id: r.n for r in rows} == {0: "john smith", 1: "finance group", 2: "mhmd khan", 3: "jose angstrom", 4: "x2"}


def test_generic_words_weigh_little(spark):
    pairs = [("africa trading co ltd", "asia trading co ltd"), ("acme trading ltd", "acme ltd"), ("a b", "c")]
    words = lambda c: NM.tokens(F.col(c))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", NM.jaccard(words("a"), words("b")), NM.weighted_jaccard(words("a"), words("b")), NM.token_set_ratio(words("a"), words("b"))).collect()
    got = {r[0]: r[1:] for r in rows}
    assert got["africa trading co ltd"][0] == 0.6 and got["africa trading co ltd"][1] < 0.2
    assert got["acme trading ltd"][1] > 0.8 and got["acme trading ltd"][2] == 1.0 and got["a b"][1] == 0


def test_configurations_are_validated():
    slots = {"DATE_OF_BIRTH", "COUNTRY", "ENTITY_TYPE", "STATUS"}
    assert SC.validated(SC.CONFIG, slots) is SC.CONFIG
    bad = [(SC.CONFIG, slots - {"COUNTRY"}), (SC.CONFIG | {"possible": 95.0}, slots), (SC.CONFIG | {"list_source": {"UN": 5.0}}, slots), (SC.CONFIG | {"weights": {"INDIVIDUAL": (1, 1, 0, 0, 0)}}, slots)]
    for config, has in bad:
        with pytest.raises(ValueError):
            SC.validated(config, has)


def test_partial_candidates_are_an_error(spark):
    rows = spark.createDataFrame([("a", "a", "INDIVIDUAL", True, *[1.0] * 5), ("b", "b", "INDIVIDUAL", False, *[1.0] * 5), ("c", "c", "INDIVIDUAL", None, *[1.0] * 5)], "l string, r string, entity_type string, complete boolean, " + ", ".join(f"{f} double" for f in SC.FEATURES))
    assert {r.l: r.band for r in SC.scored(rows).collect()} == {"a": "STRONG", "b": "ERROR", "c": "ERROR"}


def test_sinks_say_where_they_are_capped(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"v\t{k}" if k else None) for k in range(30)], "id int, v string")
    read = lambda d: [x for f in sorted((tmp_path / d).glob("part-*")) for x in f.read_text().splitlines()]
    adapters.write_tsv(rows, str(tmp_path / "some"), ["id"], 10)
    assert read("some") == ["id\tv", "0\t", *[f"{k}\tv {k}" for k in range(1, 10)], "# CAPPED 10 of 30"]
    adapters.write_tsv(rows, str(tmp_path / "all"), ["id"], 30)
    assert len(read("all")) == 31 and not read("all")[-1].startswith("#")
    adapters.write_tsv(rows, str(tmp_path / "whole"), ["id"], None)
    assert len([x for x in read("whole") if x != "id\tv"]) == 30


def test_sources_need_their_slots(spark):
    rows = spark.createDataFrame([("a ",)], "name string")
    own = adapters.bound([("PRIMARY_NAME", "name", "TRIM", None), ("ALIAS", "name", "SPLIT", " ")])
    out = adapters.canonical({"ONE": (own, rows), "TWO": (adapters.bound([("PRIMARY_NAME", "name", "RENAME", None)]), rows)}).collect()
    assert [(r.LIST_SOURCE, r.PRIMARY_NAME, r.ALIAS) for r in out] == [("ONE", "a", ["a", ""]), ("TWO", "a ", None)]
    with pytest.raises(ValueError):
        adapters.canonical({"FEED": (adapters.Adapter(lambda x: x, ("COUNTRY",)), rows)})
    with pytest.raises(ValueError):
        adapters.registered("FEED", own)
