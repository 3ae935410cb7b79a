"""File sources on micro-fixtures written to a temp folder (encodings, ragged blocks, catalog, geo)."""

from votepanel.functions.labels import harmonise_columns, harmonise_label, harmonised
from votepanel.sources import delimited as DL
from votepanel.sources import geo as G


def test_encoding_fallback_and_decimal_comma(spark, tmp_path):
    rows = "Code commune;Code BV;N° tour;Exprimés;Voix\n301;1;1;12,5;3,0\n301;2;2;10,0;4,0\n"
    (tmp_path / "cp").mkdir()
    (tmp_path / "cp" / "f.csv").write_bytes(rows.replace("Code commune", "Code commune’").encode("cp1252"))
    (tmp_path / "u8").mkdir()
    (tmp_path / "u8" / "f.csv").write_bytes(rows.encode("utf-8"))
    for d in ("cp", "u8"):
        df = DL.read_delimited(spark, str(tmp_path / d), encodings=("utf-8", "cp1252"))
        assert "Exprimés" in df.columns and "N° tour" in df.columns
        df = DL.coerce_numeric(DL.rename_by_label(df, {"Exprimés": "exprimes", "Voix": "voix"}))
        assert sorted(r.exprimes for r in df.collect()) == [10.0, 12.5]
    cp = DL.read_delimited(spark, str(tmp_path / "cp"), encodings=("utf-8", "cp1252"))
    assert "Code commune’" in cp.columns                     # windows-1252 punctuation restored


def test_repeated_blocks_ragged(spark, tmp_path):
    lines = ["a;1;x;A;10;l1;m;n;o;p;q", "b;2;y;A;5;l;m;n;o;p;q;B;7;l;m;n;o;p;q;C;1;l;m;n;o;p;q", "c;3;z", "d;4;w;A;2;l"]
    p = tmp_path / "blocks.txt"
    p.write_text("\n".join(lines) + "\n")
    df = DL.read_repeated_blocks(spark, str(p), base_width=3, block_width=8, block_fields={"code": 0, "voix": 1}, base_names=["k", "n", "x"], skip_header=False)
    got = sorted((r.k, r.cand_idx, r.code, r.voix) for r in df.collect())
    assert got == [("a", 1, "A", "10"), ("b", 1, "A", "5"), ("b", 2, "B", "7"), ("b", 3, "C", "1")]


def test_single_byte_body_under_ascii_header(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes("Commune;Voix\nSète;3\nBéziers;4\n".encode("latin-1"))
    df = DL.read_delimited(spark, str(tmp_path / "f.csv"))
    assert sorted(r.Commune for r in df.collect()) == ["Béziers", "Sète"]
    (tmp_path / "b.txt").write_bytes("Sète;1;x;Écolo;10\n".encode("latin-1") + "Mèze;2;y;A;5\n".encode())
    df = DL.read_repeated_blocks(spark, str(tmp_path / "b.txt"), base_width=3, block_width=2, block_fields={"code": 0, "voix": 1}, base_names=["k", "n", "x"], skip_header=False)
    assert sorted((r.k, r.code) for r in df.collect()) == [("Mèze", "A"), ("Sète", "Écolo")]


def test_colour_key_forms(spark):
    polys = spark.createDataFrame([("Bureau 7",), ("Bureau 12345",), (None,)], "label string")
    colours = spark.createDataFrame([("1-0007", "centre"), ("1-007", "neutral"), ("1-12345", "neutral"), ("1-123", "centre")], "code_bv string, colour_key string")
    got = {r.label: (r.code_bv, r.colour_key) for r in G.map_colour_table(polys, colours, "1").collect()}
    assert got == {"Bureau 7": ("1-0007", "centre"), "Bureau 12345": ("1-12345", "neutral"), None: (None, "no_data")}


def test_surrogate_ids_are_dense_ranks(spark):
    from votepanel.plans.warehouse import dense_ids

    keys = [(k % 7, f"b{k:03d}") for k in range(300)] + [(None, "z"), (3, "b003")]
    got = {(r.a, r.b): r.id for r in dense_ids(spark.createDataFrame(keys, "a int, b string"), ["a", "b"], start_after=10).collect()}
    order = sorted(set(keys), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert got == {k: i + 11 for i, k in enumerate(order)}


def test_catalog_inheritance():
    cat = {"base": {"path": "p0", "sep": ";", "rename_map": {"A": "a"}}, "child": {"copy_from": "base", "path": "p1", "rename_map": {"B": "b"}}}
    r = DL.resolve_catalog(cat)
    assert r["child"]["sep"] == ";" and r["child"]["path"] == "p1" and r["child"]["rename_map"] == {"A": "a", "B": "b"}


def test_station_key_nulls_and_padding(spark):
    df = spark.createDataFrame([("301", "2.0"), ("34301", "12"), (None, "1"), ("2A", "3")], "t string, s string")
    out = [r.code_bv for r in DL.build_station_key(df, ["t", "s"]).collect()]
    assert out == ["301-002", "34301-012", None, "2A-003"]


def test_label_rules():
    assert harmonise_label("Exprimés") == "Exprimés"
    assert harmonise_label("N° tour") == "N° tour"
    assert harmonise_label("Voix 3") == "Voix 3"
    assert harmonise_label("Nuance Liste 2") == "Nuance 2"
    assert harmonise_label("Code B.Vote") == "Numéro bureau de vote"


KML = """<kml xmlns="http://www.opengis.net/kml/2.2"><Document>
<Placemark><name>Bureau 01</name><Polygon><outerBoundaryIs><LinearRing><coordinates>3.0,43.0
3.1,43.0 3.1,43.1 3.0,43.0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>
<Placemark><name>Bureau 2</name><MultiGeometry><Polygon><outerBoundaryIs><LinearRing><coordinates>3.2,43.2 3.3,43.2 3.2,43.2</coordinates></LinearRing></outerBoundaryIs></Polygon>
<Polygon><outerBoundaryIs><LinearRing><coordinates>2.9,42.9 2.95,42.9 2.9,42.9</coordinates></LinearRing></outerBoundaryIs></Polygon></MultiGeometry></Placemark>
<Placemark><name>Mairie</name><Polygon><outerBoundaryIs><LinearRing><coordinates>3.0,43.0 3.0,43.05 3.0,43.0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>
</Document></kml>"""

GEOJSON = """{"type": "FeatureCollection", "features": [
 {"type": "Feature", "properties": {"name": "Bureau 01"}, "geometry": {"type": "Polygon", "coordinates": [[[3.0, 43.0], [3.1, 43.0], [3.1, 43.1], [3.0, 43.0]]]}},
 {"type": "Feature", "properties": {"name": "Bureau 2"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[3.2, 43.2], [3.3, 43.2], [3.2, 43.2]]], [[[2.9, 42.9], [2.95, 42.9], [2.9, 42.9]]]]}}]}"""


def test_polygons_bounds_and_colours(spark, tmp_path):
    (tmp_path / "p.kml").write_text(KML)
    (tmp_path / "p.geojson").write_text(GEOJSON)
    kml = G.read_polygons(spark, str(tmp_path / "p.kml"))
    gj = G.read_polygons(spark, str(tmp_path / "p.geojson"))
    assert kml.count() == 4 and gj.count() == 3
    for polys in (kml, gj):
        b = G.geo_bounds(polys).first()
        assert (b.min_lon, b.max_lon, b.min_lat, b.max_lat) == (2.9, 3.3, 42.9, 43.2)
    colours = spark.createDataFrame([("34301-0001", "centre"), ("34301-002", "neutral")], "code_bv string, colour_key string")
    got = {r.label: r.colour_key for r in G.map_colour_table(kml, colours, "34301").collect()}
    assert got == {"Bureau 01": "centre", "Bureau 2": "neutral", "Mairie": "no_data"}


def test_label_rules_in_spark_and_on_the_driver(spark):
    from pyspark.sql import functions as F

    from votepanel.plans.queries_extra import RAW_LABELS

    want = {
        "% Vot/Ins": "% Votants", "Code du d°partement": "Code du département", "Exprim°s 1": "Exprimés", "ExprimÃ©s": "Exprimés", "Libell° Abr°g° Liste 1": "Libellé Abrégé Liste 1", "Libellé abrégé de liste 1": "Libellé Abrégé Liste 1",
        "Liste": "Libellé Etendu Liste 1", "Liste.1": "Libellé Etendu Liste 1", "Libellé commune": "Libellé de la commune", "Nom T°te de Liste 1": "Nom 1", "Nom.1": "Nom 1", "Pr°nom du candidat 1": "Prénom 1",
        "Pr°nom du candidat t°te de liste": "Prénom 1", "Prénom du candidat tête de liste": "Prénom du candidat tête de liste", "NÂ°Panneau 1": "N°Panneau 1", "N.Pan. 1": "N°Panneau 1", "N° de bureau de vote": "Numéro bureau de vote",
        "Code du b.vote": "Numéro bureau de vote", "N° tour": "N° tour", "% Voix/Exprimés 3": "% Voix/Exp 3", "% Voix / Ins": "% Voix/Ins", "Nombre de voix du candidat 2": "Voix 2", "Voix": "Voix", "Code Nuance": "Code Nuance",
        "Code Nuance du candidat": "Code Nuance", "Nuance liste 4": "Nuance 4", "Sexe": "Sexe 1", "Sexe candidat 3": "Sexe 3", "Votants 1": "Votants", "Inscrits": "Inscrits", "Binôme": "Binôme", "Remarque": "Remarque",
    }
    df = spark.createDataFrame([(x,) for x in (*want, *RAW_LABELS, None)], "label string")
    got = {r.label: r.h for r in df.select("label", harmonised(F.col("label")).alias("h")).collect()}
    assert got.pop(None) is None and {k: got[k] for k in want} == want
    assert all(harmonise_label(k) == v for k, v in got.items())
    frame = spark.createDataFrame([(None, "a", "b"), ("x", "c", None)], "`Exprimés` string, `Exprim°s 1` string, `Remarque` string")
    assert [tuple(r) for r in harmonise_columns(frame).collect()] == [("a", "b"), ("x", None)]


def test_each_file_by_its_own_encoding(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "u8.csv").write_bytes("Commune;Exprimés\nSète;3\nŒuilly;1\n".encode())
    (tmp_path / "a b" / "l1.csv").write_bytes("Commune;Exprimés\nBéziers;4\n".encode("latin-1"))
    (tmp_path / "a b" / "cp.csv").write_bytes("Commune;Exprimés\nL’Isle;5\n".encode("cp1252"))
    df = DL.read_delimited(spark, str(tmp_path / "a b"))
    assert df.columns == ["Commune", "Exprimés"]
    assert sorted((r.Commune, r["Exprimés"]) for r in df.collect()) == [("Béziers", "4"), ("L’Isle", "5"), ("Sète", "3"), ("Œuilly", "1")]
    chosen = {r.file.rsplit("/", 1)[1]: r.encoding for r in DL.file_encodings(spark, str(tmp_path / "a b")).collect()}
    assert chosen == {"u8.csv": "utf-8", "l1.csv": "cp1252", "cp.csv": "cp1252"}


def test_merge_rewrites_touched_partitions_only(spark, tmp_path):
    from votepanel.plans import warehouse as WH

    path, part = f"{tmp_path}/t", WH.key_range("id", 10)
    WH.create_merge_table(spark.createDataFrame([(i, f"k{i}", float(i)) for i in range(100)], "id long, k string, v double").repartition(3), path, part)

    def files():
        return {str(f.relative_to(path)) for f in (tmp_path / "t").rglob("*.parquet")}

    before = files()
    new = spark.createDataFrame([(5, "k5", -1.0), (7, "other", 1.0), (105, "k", 2.0), (105, "k", 3.0), (None, "k", 0.0)], "id long, k string, v double")
    got = {(r.id, r.k): r.v for r in WH.merge_table(spark, path, new, ["id", "k"], part).collect()}
    assert got == {**{(i, f"k{i}"): float(i) for i in range(100)}, (5, "k5"): -1.0, (7, "other"): 1.0, (105, "k"): 3.0}
    after = files()
    assert {f for f in before if not f.startswith("part=0/")} <= after and not {f for f in before if f.startswith("part=0/")} & after
    assert {f.split("/")[0] for f in after - before} == {"part=0", "part=10"}
    got = {(r.id, r.k): r.v for r in WH.merge_table(spark, path, spark.createDataFrame([(6, "k6", 9.0), (33, "new", 9.0)], "id long, k string, v double"), ["id", "k"], part, update=False).collect()}
    assert got[6, "k6"] == 6.0 and got[33, "new"] == 9.0 and len(got) == 103
    assert {f.split("/")[0] for f in files() ^ after} == {"part=3"}  # the key that was there touched nothing
    unchanged = files()
    WH.merge_table(spark, path, new.limit(0), ["id", "k"], part)
    assert files() == unchanged


LONG = "code_commune string, code_bv string, type_scrutin string, annee int, tour int, date_scrutin date, code_candidature string, voix double, exprimes double, blancs double, nuls double, votants double, inscrits double"


def long_rows():
    import datetime as dt

    rows = []
    for i, kind in enumerate(["low", "not specified", "50%/x", None]):
        for k in range(3):
            rows.append((f"{k:05d}", f"{k:05d}-{k + 1:04d}", kind, None if k == 2 and i == 1 else 1995 + i, 1, dt.date(1995 + i, 2, 7), f"Brand#{k}", 1.5 + k, 10.0, 1.0, 2.0, 13.0, 99.25))
    return rows


def test_votes_are_computed_once_for_the_raw_files_and_every_type_is_read(spark, tmp_path, monkeypatch):
    """Types with odd characters and none at all are folders too."""
    from pyspark.sql import functions as F

    from votepanel.plans import queries_more as Q

    computed = spark.sparkContext.accumulator(0)

    def seen(v):
        computed.add(1)
        return v

    rows = long_rows()
    frame = spark.createDataFrame(rows, LONG).withColumn("type_scrutin", F.udf(seen, "string").asNondeterministic()("type_scrutin"))
    monkeypatch.setattr(Q, "fx_long", lambda spark, sf: frame)
    path, types = Q.write_raw_results(spark, "")
    assert computed.value == len(rows) and set(types) == {"low", "not specified", "50%/x", None}
    entries = DL.resolve_catalog(Q.raw_catalog(path, types))
    entries.pop("base")
    got = DL.ingest_catalog(spark, entries).select("code_bv", "type_scrutin", "code_candidature", "voix", "inscrits").collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in spark.createDataFrame(rows, LONG).select("code_bv", "type_scrutin", "code_candidature", "voix", "inscrits").collect())
    streamed = Q.q_stream_ingest(spark, "").select("code_bv", "type_scrutin", "annee", "voix").collect()
    # a year that is missing is that of the date
    want = spark.createDataFrame(rows, LONG).select("code_bv", "type_scrutin", F.year("date_scrutin").alias("annee"), "voix").collect()
    assert sorted(map(str, streamed)) == sorted(map(str, want))


def test_streams_of_all_types_run_at_once(spark, monkeypatch):
    from votepanel.plans import queries_more as Q
    from votepanel.streaming import ingest

    events = []

    class Stream:
        def __init__(self, name):
            self.name = name
            events.append(("start", name))

        def awaitTermination(self):
            events.append(("wait", self.name))
            spark.createDataFrame([], "annee int, date_scrutin date, type_scrutin string, tour int, code_bv string, inscrits double, votants double, blancs double, nuls double, exprimes double, code_candidature string, voix double").write.parquet(self.name)

        def stop(self):
            events.append(("stop", self.name))

    monkeypatch.setattr(Q, "write_raw_results", lambda spark, sf: ("/none", ["a", "b", "c"]))
    monkeypatch.setattr(ingest, "start_results_stream", lambda spark, source, cols, sink, meta, **more: Stream(sink))
    assert Q.q_stream_ingest(spark, "").count() == 0
    assert [kind for kind, _ in events] == ["start"] * 3 + ["wait"] * 3 + ["stop"] * 3


def test_numbers_and_windows_1252_as_the_long_rule_has_them(spark, tmp_path):
    texts = ["12,5", " 1 234,5 ", "1\t2", "", "  ", None, "x", "1,2,3", "-3,0", "1e3", "inf", "NaN", " 7", "5.25", "+4"]
    df = spark.createDataFrame([(t, t, 7) for t in texts], "voix string, exprimes string, inscrits int")
    long_rule = spark.createDataFrame([(t,) for t in texts], "v string").selectExpr(r"try_cast(regexp_replace(regexp_replace(v, '\\s', ''), ',', '.') as double) as v")
    want = [str(r.v) for r in long_rule.collect()]
    got = DL.coerce_numeric(df)
    assert got.columns == ["voix", "exprimes", "inscrits"]
    assert [(str(r.voix), str(r.exprimes), r.inscrits) for r in got.collect()] == [(w, w, 7.0) for w in want]
    assert [r.voix for r in DL.coerce_numeric(df.select("voix"), decimal=".").collect()][:2] == [None, None]
    keys = spark.createDataFrame([("1.00", "7"), ("12.05", " 7 "), ("123456", "0"), ("a.0", ""), (None, "1"), ("1", None), ("00", "10.0")], "t string, s string")
    assert [r.code_bv for r in DL.build_station_key(keys, ["t", "s"], widths=[5, 4]).collect()] == ["00001-0007", "12.05-0007", "123456-0000", "a-", None, None, "00000-0010"]
    (tmp_path / "f.csv").write_bytes("Commune;Voix\nL’Isle;€1\nplain;2\n".encode("cp1252"))
    assert sorted(tuple(r) for r in DL.read_delimited(spark, str(tmp_path / "f.csv")).collect()) == [("L’Isle", "€1"), ("plain", "2")]
