"""Distance joins and page extraction."""
import math
import random

import pytest
from pyspark.sql import functions as F

from parvis.operators import extraction, proximity
from parvis.plans.listing_analysis import analyse_pages
from parvis.plans.recommend import snap_coordinates


def metres(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


TAGS = [{"railway": "station"}, {"highway": "bus_stop"}, {"leisure": "park"}, {"amenity": "school"}, {"shop": "grocery"}, {"shop": "bakery"},
        {"historic": "yes", "amenity": "cafe"}, {"amenity": "fuel"}, {"natural": "tree"}]


@pytest.mark.parametrize("leaf, slice_", [(1024, 4096), (5, 20), (1, 1)])
def test_place_features_match_brute_force(spark, leaf, slice_, monkeypatch):
    rnd = random.Random(3)
    # a third of the points at one address, a third of the places on one square
    points = [(i, 48.85, 2.35) if i % 3 == 0 else (i, 48.83 + rnd.random() * 0.05, 2.30 + rnd.random() * 0.08) for i in range(120)] + [(900, 40.0, 2.0)]
    places = [(48.8501 + rnd.random() * 1e-4 if i % 3 == 0 else 48.83 + rnd.random() * 0.05, 2.30 + rnd.random() * 0.08, rnd.choice(TAGS), 50.0) for i in range(400)]
    df = proximity.classify_places(spark.createDataFrame(places, "plat double, plon double, tags map<string,string>, area_m2 double"))
    pts = spark.createDataFrame(points, "id int, latitude double, longitude double")
    monkeypatch.setattr(proximity, "LEAF", leaf)
    monkeypatch.setattr(proximity, "SLICE", slice_)
    got = {r.id: r for r in proximity.with_place_features(pts, df).collect()}
    assert len(got) == len(points)

    def near(lat, lon, test, limit=1000):
        return [d for d, t in ((metres(lat, lon, a, b), t) for a, b, t, _ in places) if d <= limit and test(t)]

    for i, lat, lon in points:
        r = got[i]
        rail = near(lat, lon, lambda t: "railway" in t)
        assert r.dist_metro_m == (pytest.approx(min(rail)) if rail else None)
        assert r.transit_count_500m == len(near(lat, lon, lambda t: "railway" in t or "highway" in t, 500))
        assert r.commerce_count_300m == len(near(lat, lon, lambda t: t.get("amenity") == "cafe" or t.get("shop") == "bakery", 300))
        assert r.heritage_count_500m == len(near(lat, lon, lambda t: "historic" in t, 500))
        assert r.park_area_500m_m2 == pytest.approx(50.0 * len(near(lat, lon, lambda t: "leisure" in t, 500)))
    assert got[900].dist_metro_m is None and got[900].transit_count_500m == 0 and got[900].walkability_score == 0.0


@pytest.mark.parametrize("latitude", [0.0, 60.0, 68.0, -89.99])
def test_pairs_of_a_crowded_cell_at_any_latitude(spark, latitude, monkeypatch):
    """90 % of points and places in one cell: the pairs are those of all pairs, and no key holds more than its share."""
    monkeypatch.setattr(proximity, "LEAF", 8)
    monkeypatch.setattr(proximity, "SLICE", 16)
    rnd = random.Random(9)
    wide = 0.03 / max(math.cos(math.radians(latitude)), 1e-3)

    def spot(i):
        scale = 0.02 if i % 10 else 1.0
        return latitude + rnd.random() * 0.009 * scale, 2.0 + rnd.random() * wide * scale

    points, places = [spot(i) for i in range(200)], [(*spot(i), i) for i in range(250)]
    pts = spark.createDataFrame(points, "latitude double, longitude double")
    df = spark.createDataFrame(places, "plat double, plon double, name int").repartition(3)
    got = {(r.lat, r.lon, r.name): r.d for r in proximity.place_distances(pts, df, 300.0).collect()}
    want = {(a, b, n): metres(a, b, c, d) for a, b in points for c, d, n in places if metres(a, b, c, d) <= 300}
    assert got.keys() == want.keys() and len(got) > 1000 and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_crowded_cells_are_dealt_to_many_keys(spark, monkeypatch):
    monkeypatch.setattr(proximity, "LEAF", 8)
    monkeypatch.setattr(proximity, "SLICE", 16)
    points = [(48.85 + i * 1e-6, 2.35 + (i * 37 % 400) * 1e-6) for i in range(400)]
    pts = spark.createDataFrame(points, "latitude double, longitude double")
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(points)], "plat double, plon double, name int")
    plan = proximity.place_distances(pts, df, 1000.0)
    assert plan.count() == 400 * 400
    keys = []
    original = type(pts).join

    def join(self, other, on=None, how=None):
        if isinstance(on, list) and on[-1] == "slice":
            keys.extend(((self, on), (other, on)))
        return original(self, other, on, how) if how else original(self, other, on)

    monkeypatch.setattr(type(pts), "join", join)
    proximity.place_distances(pts, df, 1000.0)
    (here, on), (there, _) = keys
    assert here.groupBy(on).count().agg(F.max("count")).first()[0] <= 8 * 4  # leaves of the last level may hold more
    most, n = there.groupBy(on).count().agg(F.max("count"), F.count("*")).first()
    assert most <= 40 and n > 100


def test_no_nested_loop_in_the_distance_join(spark):
    df = proximity.classify_places(spark.createDataFrame([(48.8, 2.3, {"a": "b"}, 0.0)], "plat double, plon double, tags map<string,string>, area_m2 double"))
    pts = spark.createDataFrame([(48.8, 2.3)], "latitude double, longitude double")
    plan = proximity.place_features(pts, df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_elements_use_centre_and_box(spark):
    schema = ("lat double, lon double, center struct<lat:double,lon:double>, bounds struct<minlat:double,minlon:double,maxlat:double,maxlon:double>")
    rows = [(48.85, 2.35, None, None), (None, None, (48.86, 2.36), (48.86, 2.36, 48.861, 2.362))]
    a, b = proximity.locate_places(spark.createDataFrame(rows, schema)).collect()
    assert (a.plat, a.area_m2) == (48.85, 0.0) and (b.plat, b.plon) == (48.86, 2.36)
    assert b.area_m2 == pytest.approx(metres(48.86, 2.36, 48.861, 2.36) * metres(48.86, 2.36, 48.86, 2.362))


def test_snap(spark):
    rows = [(11, 48.853, 2.3698), (11, 48.8636, 2.2735), (42, 48.0, 2.0)]
    got = snap_coordinates(spark.createDataFrame(rows, "arrondissement int, latitude double, longitude double")).collect()
    assert [(r.snapped, r.latitude, r.longitude) for r in got] == [(False, 48.853, 2.3698), (True, 48.8589, 2.3796), (False, 48.0, 2.0)]


def test_cell_enrichment_takes_first_and_defaults(spark):
    cols = "nb_restaurants double, nb_transport double, nb_parks double, walkability_score double, dist_metro_m double, nb_ecoles double"
    enriched = spark.createDataFrame([(2, 48.855, 2.35, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0), (1, 48.855, 2.35, 5.0, 5.0, None, 5.0, 5.0, 5.0)], "place_id int, lat_grid double, lon_grid double, " + cols)
    rows = spark.createDataFrame([(1, 48.8551, 2.3502), (2, 48.80, 2.30)], "id int, latitude double, longitude double")
    a, b = proximity.enrich_by_cell(rows, enriched, ["place_id"]).orderBy("id").collect()
    assert (a.nb_restaurants, a.nb_parks) == (5.0, 6.0) and (b.nb_restaurants, b.dist_metro_m) == (102.0, 214.0)


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id int, url string, html string")


LD = '<script type="application/ld+json">{}</script>'


def test_source_order_and_gaps(spark):
    html = (
        "<title>T</title>" + LD.format('{"@type":"Apartment","name":"Du bloc","offers":[{"price":"510 000"}],"address":{"postalCode":75011}}')
        + '<meta content="Appartement 3 pièces 44,5 m² 499000 € Paris 12e" name="description">'
        + "<p>dernier mot : 60 m² et 100 000 €</p>"
    )
    r = extraction.extract_listings(pages(spark, ("https://x.fr/a/1234567.htm", html)), F.lit("2025-01-01")).first()
    assert (r.titre, r.prix, r.surface, r.pieces, r.arrondissement, r.source) == ("Du bloc", 510000, 44.5, 3, 11, "Inconnu")
    assert r.latitude is None and r.days_on_market is None


def test_text_fallback_only_for_some_sites(spark):
    html = "<p>Studio&nbsp;1 pièce, 18,5 m2, 150 000 €, Paris 1er</p><script>9 €</script>"
    a, b = extraction.extract_listings(pages(spark, ("https://www.pap.fr/1", html), ("https://www.seloger.com/1", html)), F.lit("2025-01-01")).collect()
    assert (a.prix, a.surface, a.pieces, a.arrondissement) == (150000, 18.5, 1, 1)
    assert (b.prix, b.surface) == (None, None)


@pytest.mark.parametrize(
    "text,floor,total",
    [("Au RDC", 0, None), ("rez-de-chaussée", 0, None), ("3ème étage sur 6", 3, 6), ("1er étage", 1, None), ("Dernier étage", 6, None),
     ("5ème et dernier étage", 5, None), ("rien", None, None)],
)
def test_floor(spark, text, floor, total):
    r = extraction.listing_features(pages(spark, ("u", f"<p>{text}</p>"))).first()
    assert (r.etage, r.nb_etages) == (floor, total)


def test_listing_features(spark):
    html = "<p>Bel appartement rénové, parquet, cave. Charges : 5 €. 220 € / mois de charges. DPE : c. Exposition Sud-Est. Box.</p>"
    r = extraction.listing_features(pages(spark, ("u", html))).first()
    assert (r.dpe_classe, r.exposition, r.charges_mensuelles) == ("C", "SE", 220)
    assert r.renovation_score == 0.375 and r.has_cave and r.has_parking and not r.has_balcon
    assert r.features_found == ["DPE C", "rénov", "parquet", "cave", "Charges 220 €/mois", "Parking/Box", "Cave", "Exposition SE"]


def test_photos(spark):
    html = (
        '<meta property="og:image" content="https://c.fr/a.jpg#x">' + LD.format('{"image":["https://c.fr/b.jpg",{"url":"https://c.fr/a.jpg?ci_seal=1"}]}')
        + r'"https:\/\/mms.seloger.com\/q.webp?ci_seal=2","https://v.bienici.com/z.png"' + "".join(f' "https://mms.seloger.com/{i}.jpg"' for i in range(9))
    )
    r = extraction.photo_urls(pages(spark, ("u", html))).first()
    assert r.photos == ["https://c.fr/a.jpg?ci_seal=1", "https://mms.seloger.com/q.webp?ci_seal=2", "https://c.fr/b.jpg",
                        "https://mms.seloger.com/0.jpg", "https://mms.seloger.com/1.jpg"]


def test_vision_answers(spark):
    raws = ['```json\n{"renovation_score": 9, "luminosite": "Sombre", "has_outdoor_space": true}\n```', "rien", '{"renovation_score": "deux", "space_category": "XXL"}', '{"renovation_score": 2, ']
    rows = extraction.normalise_vision(spark.createDataFrame([(r,) for r in raws], "raw string")).collect()
    assert [r.renovation_score for r in rows] == [5, 3, 3, 3]
    assert (rows[0].luminosite, rows[0].has_outdoor_space, rows[2].space_category) == ("Sombre", True, "Standard")


def test_cards(spark):
    rows = [("T Paris 75015", "510 000 €", "44.5 m² net"), ("Studio 3ème", "49 999 €", "20 m²"), ("Loft", "90000", "nc")]
    got = extraction.parse_cards(spark.createDataFrame(rows, "title string, price_text string, surface_text string")).collect()
    assert [(r.prix_annonce, r.surface, r.arrondissement) for r in got] == [(510000, 44.5, 15), (90000, 50.0, 11)]


def test_top_up(spark):
    reserve = spark.createDataFrame([(i, f"flat {i}") for i in range(8)], "position int, titre string")
    assert extraction.top_up(reserve.limit(2), reserve).count() == 8
    assert extraction.top_up(reserve.limit(4), reserve).count() == 4


def test_incomplete_pages_are_routed(spark):
    done = analyse_pages(
        pages(spark, ("https://www.pap.fr/1", "<p>20 m², 150 000 €, Paris 3e</p>"), ("https://www.pap.fr/2", "<p>vide</p>")),
        F.lit("2025-01-01"), lambda x: x.withColumn("prix_m2_predit", F.lit(10_000.0)),
    ).orderBy("page_id").collect()
    assert [r.status for r in done] == ["complete", "needs_input"] and done[1].missing == ["prix", "surface", "arrondissement"]
    a = done[0]
    assert a.pieces == 1 and a.gem_score == pytest.approx((10_000 * 0.97 * 0.95 - 150_000 * 0.93 / 20) / (10_000 * 0.97 * 0.95))
    assert done[1].gem_score is None


@pytest.mark.parametrize("latitude", [48.8, 60.17, 68.4])
def test_no_pair_is_lost_in_the_north(spark, latitude):
    import random

    rng = random.Random(int(latitude))
    spot = lambda: (latitude + rng.uniform(-0.02, 0.02), 24.9 + rng.uniform(-0.04, 0.04))
    points, places = [spot() for _ in range(30)], [spot() for _ in range(60)]
    got = proximity.place_distances(spark.createDataFrame(points, "latitude double, longitude double"), spark.createDataFrame(places, "plat double, plon double"), radius=1000.0)
    want = {(a, b, c, d) for a, b in points for c, d in places if metres(a, b, c, d) <= 1000.0}
    assert {(r.lat, r.lon, r.plat, r.plon) for r in got.collect()} == want


def test_histogram_of_a_constant(spark):
    from parvis.operators.evaluation import histogram

    rows = histogram(spark.createDataFrame([(5.0,)] * 3, "x double"), "x", 4).orderBy("bin").collect()
    assert [r.n for r in rows] == [3, 0, 0, 0]


def test_references_and_odd_blanks(one_row):
    from parvis.functions import text

    cases = {
        "4&egrave;me&nbsp;&#233;tage": "4ème étage", "12&#x202F;000&nbsp;&#8364;": "12 000 €", "50 m&#178;": "50 m²", "&#128; &#X41;": "€ A",
        "&amp;#8364; &amp;amp;": "&#8364; &amp;", "a & b &c &inconnu; &#0; &#xD800;": "a & b &c &inconnu; &#0; &#xD800;", "&#128512;": "\U0001F600", "": "",
    }
    got = one_row(*[text.visible_text(F.lit(c)) for c in cases])
    assert list(got) == list(cases.values())
    assert one_row(text.visible_text(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("blank", ["\u00a0", "\u202f", "\u2009", "&nbsp;", "&#160;", " "])
def test_facts_before_a_colon(spark, blank):
    html = f"<p>4ème étage sur 6. DPE{blank}: C. Exposition{blank}: sud. Charges{blank}: 120{blank}€</p>"
    row = extraction.listing_features(pages(spark, ("https://www.pap.fr/1", html))).first()
    assert (row.etage, row.nb_etages, row.dpe_classe, row.exposition, row.charges_mensuelles) == (4, 6, "C", "S", 120)


def test_incomplete_pages_have_no_price(spark):
    done = analyse_pages(
        pages(spark, ("https://www.pap.fr/2", "<p>20 m², Paris 3e</p>")), F.lit("2025-01-01"), lambda x: x.withColumn("prix_m2_predit", F.lit(10_000.0)),
    ).first()
    assert done.status == "needs_input"
    assert [done[c] for c in ("prix_m2_predit", "prix_corrige_m2", "prix_net_m2", "gem_score", "prix_predit_total", "gain_potentiel")] == [None] * 6


def test_summary_tells_district_0_from_all(spark):
    from parvis.operators.market import market_summary

    rows = spark.createDataFrame([(92100.0, 5000.0, 30.0), (75011.0, 9000.0, 40.0)], "code_postal double, prix_m2 double, surface_reelle_bati double")
    got = {(r.zone, r.is_total): r["count"] for r in market_summary(rows).collect()}
    assert got == {(0, False): 1, (11, False): 1, (None, True): 2}


STATES = [
    # (state, prix, surface, pieces, arrondissement, date)
    ('{"prix": 2, "price": 1}', 2, None, None, None, None),  # document order, not the order of names
    ('{"a": {"b": [{"PRICE": 3.9}]}, "price": 1}', 3, None, None, None, None),
    ('{"price": "5", "x": {"price": true, "y": {"price": 0, "prix": -4}}, "prix": 9}', None, None, None, None, None),  # a negative price ends the search
    ('{"note": "\\"price\\": 7, \\"cp\\":75003", "cp": "75 011"}', None, None, None, 11, None),
    ('{"l": [0, 1, 2, 3, {"area": 4.5}, {"rooms": 5}], "m": [[{"rooms": 6}]], "pieces": 7}', None, 4.5, 7, None, None),
    ('{"price": {"price": {"amount": 1, "price": 8}}, "surface": null, "SURFACE": {"area": 20}}', 8, 20.0, None, None, None),
    ('{"createdAt": 20240101, "x": [{"publishedAt": ""}, {"insertionDate": "2024-05-06"}], "codepostal": 75000, "cp": 75020.0}', None, None, None, 20, "2024-05-06"),
    ('{"price": 1e999, "prix": NaN, "deep": {"price": 123456789012345678901234567890, "prix": 10}}', 10, None, None, None, None),
    ('{"a": ' * 5000 + "1" + "}" * 5000, None, None, None, None, None),
    ('{"cp": "n/c", "postalCode": "750,5", "codePostal": "75005,0"}', None, None, None, 50, None),
    ("[1]", None, None, None, None, None), ("{}", None, None, None, None, None), ('{"price": 1,', None, None, None, None, None),
]


def test_key_search_walks_the_document(spark):
    pages = [(i, "u", f"<script>window.__PRELOADED_STATE__ = {s};</script>") for i, (s, *_) in enumerate(STATES)]
    pages += [(100, "u", None), (101, "u", ""), (102, "u", 'window.DATA_LAYER = {"price": x}; "listing": {"price": 44, "note": "long enough"}')]
    df = extraction.with_source(spark.createDataFrame(pages, "id int, url string, html string"), "keys")
    got = {r.id: (r.keys_prix, r.keys_surface, r.keys_pieces, r.keys_arrondissement, r.keys_date_publication) for r in df.collect()}
    for i, (state, *want) in enumerate(STATES):
        assert got[i] == tuple(want), state[:80]
    assert got[100] == got[101] == (None,) * 5 and got[102] == (44, None, None, None, None)


def test_key_search_against_a_plain_walk():
    from parvis.functions import json_search

    rnd = random.Random(6)

    def value(depth):
        kind = rnd.randint(0, 7 if depth else 4)
        if kind >= 6:
            return {rnd.choice(["price", "Prix", "x", "Area", "cp", "y", "rooms", "createdat"]): value(depth - 1) for _ in range(rnd.randint(0, 5))}
        if kind == 5:
            return [value(depth - 1) for _ in range(rnd.randint(0, 8))]
        return rnd.choice([0, 1, 2.5, "75012", "", "t", None, True])

    def walk(node):
        for k, v in node.items():
            yield k.lower(), v
            for child in [v] if isinstance(v, dict) else v[:5] if isinstance(v, list) else []:
                if isinstance(child, dict):
                    yield from walk(child)

    import json

    for _ in range(400):
        document = {"x": value(4), "y": value(4)}
        want = {}
        for field, (names, accept) in json_search.FIELDS.items():
            hits = [accept(v) for k, v in walk(document) if k in names and accept(v) is not None]
            if hits:
                want[field] = hits[0]
        assert json_search.find([None, "{", json.dumps(document)]) == want


def test_state_in_a_string_literal(spark):
    import json

    def page(listing, script=lambda t: json.dumps(t)[1:-1]):  # the state written as a literal
        state = json.dumps({"app_cldp": {"data": {"classified": listing}}})
        return f'<script>window["__UFRN_LIFECYCLE_SERVERREQUEST__"] = JSON.parse("{script(state)}");\n other("");</script>'

    cases = [
        (page({"price": 5, "surface": "30,5", "rooms": 2}), (5, 30.5, 2)),
        (page({"Prix": "1 200 000", "Surface": 9, "nbPieces": 3, "name": 'quote " back \\ slash / \n \U0001f600 \\" ")'}), (1200000, 9.0, 3)),
        (page({"price": 7, "name": "e"}, lambda t: json.dumps(t)[1:-1].replace(': \\"e', r': \"\xe9\'')), (7, None, None)),
        (page({"price": 0, "surface": None}), (None, None, None)),
        ('window["__UFRN_LIFECYCLE_SERVERREQUEST__"] = JSON.parse("{\\"app_cldp\\": 1}");', (None, None, None)),
        ('window["__UFRN_LIFECYCLE_SERVERREQUEST__"] = JSON.parse("{broken");', (None, None, None)),
        ('window["__UFRN_LIFECYCLE_SERVERREQUEST__"] = JSON.parse("never closed', (None, None, None)), ("", (None, None, None)), (None, (None, None, None)),
    ]
    df = spark.createDataFrame([(i, h, "https://www.seloger.com/x") for i, (h, _) in enumerate(cases)], "id int, html string, url string")
    got = {r.id: r for r in extraction.with_source(df, "request").collect()}
    for i, (html, want) in enumerate(cases):
        assert (got[i].request_prix, got[i].request_surface, got[i].request_pieces) == want, html
    literal = spark.createDataFrame([(r"a\"b\\x41\x41\'é\\\x42",)], "t string").select(extraction.string_literal(F.col("t"))).first()[0]
    assert literal == 'a"b\\x41A\'é\\B'
    # the literal fills what is missing while price or area is, and only then
    known = '<meta name="description" content="Vente 3 pièces 44 m² 510000 € Paris (75017)">'
    partial = '<meta name="description" content="Vente 44 m² Paris 17e">'
    pages = spark.createDataFrame([(0, known + cases[0][0]), (1, partial + cases[0][0])], "id int, html string").withColumn("url", F.lit("https://www.seloger.com/1"))
    rows = {r.id: (r.prix, r.surface, r.pieces) for r in extraction.extract_listings(pages, F.lit("2024-01-01")).collect()}
    assert rows == {0: (510000, 44.0, 3), 1: (5, 44.0, 2)}


def test_first_photo(spark):
    ld = '<script type="application/ld+json">{}</script>'
    cases = [
        ('<meta property="og:image" content=" https://a/1.jpg ">' + ld.format('{"image": "https://b/2.jpg"}'), "https://a/1.jpg"),
        ('<meta property="og:image" content="/a/1.jpg">' + ld.format('[{"image": [{"contentUrl": "https://b/3.jpg"}, "https://b/4.jpg"]}]'), "https://b/3.jpg"),
        (ld.format('{"image": []}') + ld.format('{"image": "https:\\/\\/b\\u002F5.jpg"}'), "https://b/5.jpg"),
        ('<img src="https://x/y.gif"><IMG alt="a" src=\'https://CDN.x/6.jpg\'>', "https://CDN.x/6.jpg"),
        ('<img data-src="https://cdn/7.jpg"><img src="cdn/8.jpg">', None), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "id int, html string")
    assert {r.id: r.photo_url for r in extraction.first_photo(df).collect()} == {i: want for i, (_, want) in enumerate(cases)}
    escaped = spark.createDataFrame([('"https:\\u002F\\u002fmms.seloger.com\\u002Fp\\/a.jpg"',)], "html string")
    assert extraction.photo_urls(escaped).first().photos == ["https://mms.seloger.com/p/a.jpg"]
