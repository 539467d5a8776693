"""Sales-like views derived from the given tables.

The column expressions are plain SQL that Spark and DuckDB both accept, so the
two sides start from the same rows. Everything after that is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parvis.operators.cleaning import clean_sales
from parvis.operators.encodings import plain_encoding, with_keys
from parvis.operators.features import split_train_test

NBSP = " "

TX = {
    "id_mutation": "l_orderkey",
    "l_linenumber": "l_linenumber",
    "l_partkey": "l_partkey",
    "l_suppkey": "l_suppkey",
    "date_mutation": "CAST(l_shipdate AS DATE)",
    "valeur_fonciere": "l_extendedprice * 4.0e0",
    "surface_reelle_bati": "l_quantity",
    "nombre_pieces_principales": "l_linenumber",
    "type_local": """CASE WHEN p_type IN ('STANDARD', 'PROMO', 'MEDIUM') THEN 'Appartement'
        WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'Maison' ELSE 'Dependance' END""",
    "code_postal": "CAST(75001 + l_suppkey % 20 AS DOUBLE)",
    "code_departement": "CAST(75 + l_suppkey % 4 AS STRING)",
    "adresse_numero": "CAST(l_linenumber AS STRING)",
    "adresse_nom_voie": "'RUE ' || upper(p_name)",
    "adresse_code_voie": "CAST(l_suppkey AS STRING)",
    "latitude": "48.82e0 + (l_suppkey % 97) * 0.0008e0",
    "longitude": "2.26e0 + (l_partkey % 89) * 0.0017e0",
    "nombre_lots": "CAST(1 + l_partkey % 3 AS INT)",
    "lot1_surface_carrez": "CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 0.95e0 END",
}
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "date_mutation", "valeur_fonciere"]

LISTING = {
    "id_mutation": "id_mutation",
    "titre": "type_local || ' ' || CAST(nombre_pieces_principales AS STRING) || ' p'",
    "arrondissement": "CAST(CAST(code_postal AS BIGINT) % 100 AS INT)",
    "surface": "surface_reelle_bati",
    "pieces": "nombre_pieces_principales",
    "type_local": "type_local",
    "valeur_fonciere": "valeur_fonciere",
    "prix_m2": "prix_m2",
    "prix_annonce": "CAST(floor(valeur_fonciere * (0.80e0 + (id_mutation % 41) * 0.01e0)) AS BIGINT)",
    "latitude": "CASE WHEN id_mutation % 7 <> 0 THEN latitude END",
    "longitude": "CASE WHEN id_mutation % 7 <> 0 THEN longitude END",
    "etage": "CASE WHEN id_mutation % 9 < 8 THEN CAST(id_mutation % 9 AS INT) END",
    "dpe_classe": "CASE WHEN id_mutation % 8 < 7 THEN substr('ABCDEFG', CAST(1 + id_mutation % 8 AS INT), 1) END",
    "exposition": """CASE CAST(id_mutation % 9 AS INT) WHEN 0 THEN 'S' WHEN 1 THEN 'SE' WHEN 2 THEN 'SO' WHEN 3 THEN 'E'
        WHEN 4 THEN 'O' WHEN 5 THEN 'N' WHEN 6 THEN 'NE' WHEN 7 THEN 'NO' END""",
    "renovation_score": "(id_mutation % 9) / 8.0e0",
    "vision_score": "CASE WHEN id_mutation % 3 = 0 THEN CAST(1 + id_mutation % 5 AS INT) END",
    "luminosite": "CASE CAST(id_mutation % 4 AS INT) WHEN 0 THEN 'Lumineuse' WHEN 1 THEN 'Sombre' WHEN 2 THEN 'Moyenne' END",
    "hauteur_plafond": "CASE CAST(id_mutation % 3 AS INT) WHEN 0 THEN 'Haute' WHEN 1 THEN 'Basse' END",
    "qualite_generale": "CASE CAST(id_mutation % 5 AS INT) WHEN 0 THEN 'Premium' WHEN 1 THEN 'Basique' WHEN 2 THEN 'Standard' END",
    "days_on_market": "CASE WHEN id_mutation % 4 <> 0 THEN CAST((id_mutation * 37) % 400 AS INT) END",
}

_AREA = "CAST(CAST(surface AS INT) AS STRING)"
_ROOMS = "CAST(pieces AS STRING)"
_PRICE = "CAST(prix_annonce AS STRING)"
_ARR = "CAST(arrondissement AS STRING)"
_CODE = "'750' || lpad(CAST(arrondissement AS STRING), 2, '0')"
_SPACED = "CAST(CAST(floor(prix_annonce / 1000) AS BIGINT) AS STRING) || '{s}' || lpad(CAST(prix_annonce % 1000 AS STRING), 3, '0')"
_DAY = "CAST(date_add(DATE '2024-01-01', CAST(id_mutation % 300 AS INT)) AS STRING)"
_HOST = """CASE CAST(id_mutation % 5 AS INT) WHEN 0 THEN 'seloger.com' WHEN 1 THEN 'leboncoin.fr' WHEN 2 THEN 'pap.fr'
    WHEN 3 THEN 'bienici.com' ELSE 'example.com' END"""
_PHOTO = "'https://mms.seloger.com/p/' || CAST(id_mutation % 1000 AS STRING)"


def _when(test: str, text: str) -> str:
    return f"CASE WHEN {test} THEN {text} ELSE '' END"


_OFFER = f"""'{{"price":' || {_PRICE} || '}}'"""
_LD = f"""'"@type":"' || CASE WHEN id_mutation % 10 = 7 THEN 'WebPage' WHEN type_local = 'Maison' THEN 'House' ELSE 'Apartment' END
    || '","name":"' || titre || '","floorSize":{{"value":' || {_AREA} || '}},"numberOfRooms":' || {_ROOMS}
    || ',"address":{{"postalCode":"' || {_CODE} || '"}},"datePublished":"' || {_DAY} || 'T08:30:00"
    ,"image":["' || {_PHOTO} || '-b.jpg","' || {_PHOTO} || '-c.png?ci_seal=1"]'"""

PAGE_PARTS = [
    "'<!DOCTYPE html><html><head><title>' || titre || ' &amp; co</title>'",
    _when("id_mutation % 4 < 2", f"""'<meta property="og:title" content="Vente T' || {_ROOMS} || '/F' || {_ROOMS} || '">'"""),
    _when(
        "id_mutation % 4 IN (0, 2)",
        f"""'<meta name="description" content="Appartement à vendre ' || {_ROOMS} || ' pièces ' || {_AREA} || ' m² ' || {_SPACED.format(s=NBSP)}
        || ' € Paris (' || {_CODE} || ')">'""",
    ),
    _when("id_mutation % 3 = 0", f"""'<meta property="og:image" content="' || {_PHOTO} || '-a.jpg?ci_seal=9#top">'"""),
    "'<style>p{margin:0}</style>'",
    _when("id_mutation % 6 = 1", f"""'<script type="application/ld+json">{{' || {_LD} || ',"offers":' || {_OFFER} || '}}</script>'"""),
    _when("id_mutation % 6 = 2", f"""'<script type="application/ld+json">[{{' || {_LD} || ',"offers":[' || {_OFFER} || ']}}]</script>'"""),
    _when(
        "id_mutation % 5 = 1",
        f"""'<script id="__NEXT_DATA__" type="application/json">{{"props":{{"pageProps":{{"ad":{{"subject":"' || titre || ' lbc","price":[' || {_PRICE}
        || '],"attributes":[{{"key":"rooms","value":"' || {_ROOMS} || '"}},{{"key":"square","value":"' || {_AREA} || '","value_label":"' || {_AREA} || ' m²"}}]'
        || ',"location":{{"zipcode":"' || {_CODE} || '","lat":48.85,"lng":2.35}}}}}}}}}}</script>'""",
    ),
    _when(
        "id_mutation % 10 = 3",
        f"""'<script id="__NEXT_DATA__" type="application/json">{{"props":{{"pageProps":{{"listingData":{{"title":"' || titre || ' bi","price":' || {_PRICE}
        || ',"surfaceArea":' || {_AREA} || ',"roomsQuantity":' || {_ROOMS} || ',"postalCode":"' || {_CODE}
        || '","blurInfo":{{"position":{{"lat":48.86,"lon":2.34}}}}}}}}}}}}</script>'""",
    ),
    _when(
        "id_mutation % 6 = 5",
        f"""'<script>window.__PRELOADED_STATE__ = {{"view":{{"Prix":' || {_PRICE} || ',"area":' || {_AREA} || ',"rooms":' || {_ROOMS}
        || ',"cp":"' || {_CODE} || '","createdAt":"' || {_DAY} || '"}}}};</script>'""",
    ),
    # a state with decoys: keys inside strings, values of other kinds, zeros, the sixth entry of a list, a list in a list
    _when(
        "id_mutation % 12 = 4",
        f"""replace('<script>window.DATA_LAYER = {{"note":"~"price~": 1, ~"cp~":75003","Price":"n/c","rooms":null,"empty":{{"prix":0,"createdAt":""}},
        "six":[1,2,[{{"price":7}}],4,5,{{"price":8}}],"deep":[[{{"area":9}}],{{"a":{{"zip":[{{"cp":"75 0', '~', chr(92)) || lpad({_ARR}, 2, '0')
        || '"}},{{"CodePostal":75020}}]}}}}],"prix":' || {_PRICE} || '.75,"price":5,"surface":{{"total":1,"area":' || {_AREA} || '.5}},"NumberOfRooms":' || {_ROOMS}
        || ',"publishedAt":"' || {_DAY} || '"}};</script>'""",
    ),
    # the second pattern cannot be read, so the third counts
    _when(
        "id_mutation % 12 = 8",
        f"""'<script>window.DATA_LAYER = {{"price":1,"x":nope}}; x = {{"listing": {{"price":' || {_PRICE} || ',"surface":"?","rooms":' || {_ROOMS} || '}}}}</script>'""",
    ),
    # a state in a string literal, with quotes and letters escaped
    _when(
        "id_mutation % 4 = 3",
        f"""replace('<script>window["__UFRN_LIFECYCLE_SERVERREQUEST__"] = JSON.parse("{{~"app_cldp~":{{~"data~":{{~"classified~":{{~"name~":~"~u00e9t~u00E9 ~~~"T3~~~" ~~~~ ~ud83d~ude00~",~"', '~', chr(92))
        || CASE WHEN id_mutation % 8 = 3 THEN 'price' ELSE 'Prix' END || chr(92) || '":' || {_PRICE} || replace(',~"surface~":~"' || {_AREA} || ',25~",~"nbPieces~":' || {_ROOMS} || '}}}}}}}}");', '~', chr(92)) || chr(10) || '</script>'""",
    ),
    f"""'</head><body><!-- page --><p>' || type_local || ' <b>' || {_ROOMS} || '&nbsp;pièces</b> de ' || {_AREA} || ' m²</p><p>' || {_SPACED.format(s=' ')}
        || ' &euro;</p><p>Paris ' || {_ARR} || CASE WHEN arrondissement = 1 THEN 'er' ELSE 'ème' END || '</p>'""",
    """CASE CAST(id_mutation % 7 AS INT) WHEN 0 THEN '<p>Au RDC sur cour</p>' WHEN 1 THEN '<p>Dernier&nbsp;&eacute;tage avec vue, s&ucirc;r &#8209; &inconnu;</p>'
        WHEN 2 THEN '<p>5ème et dernier étage</p>' WHEN 3 THEN '' ELSE '<p>' || CAST(id_mutation % 7 AS STRING) || 'ème étage sur 8</p>' END""",
    _when("id_mutation % 8 < 7", "'<p>DPE&nbsp;: ' || substr('ABCDEFG', CAST(1 + id_mutation % 8 AS INT), 1) || '.</p>'"),
    _when("id_mutation % 3 = 0", "'<p>Parquet, cave, gardien et ascenseur. Haussmannien lumineux.</p>'"),
    _when("id_mutation % 3 = 1", "'<p>Bel ancien de standing, refait à neuf, balcon et parking.</p>'"),
    """CASE CAST(id_mutation % 4 AS INT) WHEN 0 THEN '<p>Charges&#160;: ' || CAST(50 + id_mutation % 300 AS STRING) || ' €</p>'
        WHEN 1 THEN '<p>' || CAST(50 + id_mutation % 300 AS STRING) || ' € / mois de charges</p>' WHEN 2 THEN '<p>charges de 9 €/mois</p>' ELSE '' END""",
    """CASE CAST(id_mutation % 6 AS INT) WHEN 0 THEN '<p>Exposition sud-ouest, terrasse</p>' WHEN 1 THEN '<p>exposition&#x202F;: Nord Est</p>'
        WHEN 2 THEN '<p>EXPOSITION OUEST</p>' ELSE '' END""",
    _when(
        "id_mutation % 2 = 0",
        f"""'<img data-x="https:' || chr(92) || '/' || chr(92) || '/mms.seloger.com' || chr(92) || '/p' || chr(92) || '/' || CAST(id_mutation % 1000 AS STRING) || '-b.jpg?ci_seal=7">'""",
    ),
    """CASE CAST(id_mutation % 5 AS INT) WHEN 0 THEN '<img src="/local/photo.png"><img class="x" src="https://media.example/' || CAST(id_mutation AS STRING) || '.jpg">' WHEN 1 THEN '<img src="https://example.org/x.gif">' ELSE '' END""",
    _when("id_mutation % 9 = 4", f"""replace('<i data-p="https:~u002F~u002Fmms.seloger.com~u002fp~u002F', '~', chr(92)) || CAST(id_mutation % 1000 AS STRING) || '-z.webp"></i>'"""),
    "'</body></html>'",
]
LISTING_PAGE = {
    "page_id": "id_mutation",
    "url": f"""'https://www.' || {_HOST} || '/achat/' || lower(type_local) || '/paris-' || {_ARR} || CASE WHEN arrondissement = 1 THEN 'er' ELSE 'eme' END
        || '-75/' || CAST(100000 + id_mutation AS STRING) || '.htm'""",
    "html": " || ".join(f"({p})" for p in PAGE_PARTS),
}

CARD = {
    "id_mutation": "id_mutation",
    "title": "type_local || ' Paris ' || CAST(arrondissement AS STRING) || 'e'",
    "price_text": "CAST(CAST(floor(prix_annonce / (1 + 9 * (id_mutation % 2))) AS BIGINT) AS STRING) || ' €'",
    "surface_text": f"CASE WHEN id_mutation % 5 > 0 THEN 'env. ' || {_AREA} || '.5 m² habitables' ELSE 'nc' END",
}

VISION = {
    "listing_id": "id_mutation % 5000",
    "photo_index": "id_mutation",
    "raw": """CASE CAST(id_mutation % 6 AS INT)
        WHEN 0 THEN '```json {"renovation_score": ' || CAST(id_mutation % 8 AS STRING) || CASE WHEN id_mutation % 7 = 0 THEN '.5' ELSE '' END || ', "space_category": "Spacieux", "luminosite": "Sombre",'
            || ' "hauteur_plafond": "Haute", "has_outdoor_space": true, "qualite_generale": "Premium", "reasoning": "ok"} ```'
        WHEN 1 THEN 'Voici : {"renovation_score": "' || CAST(id_mutation % 5 AS STRING) || CASE WHEN id_mutation % 7 = 0 THEN '.5' ELSE '' END || '", "space_category": "Grand", "luminosite": "Lumineuse"} fin'
        WHEN 2 THEN '{"renovation_score": null, "has_outdoor_space": false, "qualite_generale": "Basique"}'
        WHEN 3 THEN 'pas de réponse'
        WHEN 4 THEN '{"renovation_score": 3, "space_category"'
        ELSE '{"renovation_score": 4.0, "hauteur_plafond": "Basse", "reasoning": "travaux"}' END""",
}

REQUEST = {
    "id_mutation": "l_orderkey",
    "l_linenumber": "l_linenumber",
    "l_partkey": "l_partkey",
    "l_suppkey": "l_suppkey",
    "surface": "l_quantity * 45.0e0 - 60.0e0",
    "pieces": "l_linenumber * 4 - 4",
    "arrondissement": "CAST(l_suppkey % 23 AS INT)",
    "latitude": "48.65e0 + (l_partkey % 50) * 0.01e0",
    "longitude": "1.95e0 + (l_suppkey % 90) * 0.01e0",
    "annee": "CASE WHEN l_partkey % 3 > 0 THEN CAST(2018 + l_partkey % 14 AS INT) END",
    "mois": "CAST(l_partkey % 14 AS INT)",
    "trimestre": "l_linenumber % 6",
    "nombre_lots": "CAST(l_partkey % 12 AS INT)",
    "prix_affiche": "CASE WHEN l_suppkey % 4 > 0 THEN l_extendedprice - 5000.0e0 END",
    "adresse_code_voie": "CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN CAST(l_suppkey AS STRING) WHEN 1 THEN 'ZZZZ' END",
}

PLACE = {
    "place_id": "c_custkey",
    "plat": "48.80e0 + (c_custkey * 7919 % 1000) * 0.0001e0",
    "plon": "2.25e0 + (c_custkey * 104729 % 1700) * 0.0001e0",
    "kind": "c_mktsegment",
    "area_m2": "CASE WHEN c_mktsegment = 'BUILDING' THEN 100.0e0 + (c_custkey % 50) ELSE 0.0e0 END",
}
# kind -> tag, so that classification is exercised on the way
PLACE_TAGS = {
    "AUTOMOBILE": ("railway", "station"),
    "BUILDING": ("leisure", "park"),
    "FURNITURE": ("amenity", "school"),
    "HOUSEHOLD": ("shop", "supermarket"),
    "MACHINERY": ("amenity", "restaurant"),
}

SEARCH = {
    "search_id": "n_nationkey",
    "budget": "150000.0e0 + n_nationkey * 20000.0e0",
    "wanted": "CASE WHEN n_nationkey % 5 > 0 THEN CAST(1 + n_nationkey % 20 AS INT) END",
    "surface_min": "CAST(n_nationkey % 4 * 5 AS DOUBLE)",
    "surface_max": "CAST(30 + n_nationkey AS DOUBLE)",
    "pieces_min": "CAST(1 + n_nationkey % 3 AS INT)",
}

ENRICHED = {
    "place_id": "c_custkey",
    "lat_grid": "48.80e0 + (c_custkey * 7919 % 24) * 0.005e0",
    "lon_grid": "2.25e0 + (c_custkey * 104729 % 32) * 0.005e0",
    "nb_restaurants": "CAST(c_custkey % 150 AS DOUBLE)",
    "nb_transport": "CAST(c_custkey % 40 AS DOUBLE)",
    "nb_parks": "CASE WHEN c_custkey % 11 > 0 THEN CAST(c_custkey % 9 AS DOUBLE) END",
    "walkability_score": "CAST(c_custkey % 100 AS DOUBLE)",
    "dist_metro_m": "CAST(50 + c_custkey % 800 AS DOUBLE)",
    "nb_ecoles": "CAST(c_custkey % 15 AS DOUBLE)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def tx(spark, sf_dir) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return _pick(lines.join(parts, lines["l_partkey"] == parts["p_partkey"]), TX)


def clean(spark, sf_dir) -> DataFrame:
    return clean_sales(tx(spark, sf_dir), ORDER)


def predictions(spark, sf_dir) -> DataFrame:
    """District mean of the training rows as a stand-in model, on the test rows."""
    train, test = split_train_test(clean(spark, sf_dir))
    means = plain_encoding(train, ["arrondissement"], "prix_predit")
    return with_keys(test).join(F.broadcast(means), "arrondissement").withColumn("prix_reel", F.col("prix_m2"))


def listings(spark, sf_dir) -> DataFrame:
    return _pick(clean(spark, sf_dir), LISTING)


def listing_pages(spark, sf_dir) -> DataFrame:
    return _pick(listings(spark, sf_dir), LISTING_PAGE)


def cards(spark, sf_dir) -> DataFrame:
    return _pick(listings(spark, sf_dir), CARD)


def vision_answers(spark, sf_dir) -> DataFrame:
    return _pick(listings(spark, sf_dir), VISION)


def requests(spark, sf_dir) -> DataFrame:
    return _pick(table(spark, sf_dir, "lineitem"), REQUEST)


def places(spark, sf_dir) -> DataFrame:
    """Places with a tag map, classified by the library."""
    from parvis.operators.proximity import classify_places

    kinds = F.create_map(*[x for k, (key, value) in PLACE_TAGS.items() for x in (F.lit(k), F.create_map(F.lit(key), F.lit(value)))])
    raw = _pick(table(spark, sf_dir, "customer"), PLACE)
    return classify_places(raw.withColumn("tags", F.try_element_at(kinds, F.col("kind"))))


def searches(spark, sf_dir) -> DataFrame:
    return _pick(table(spark, sf_dir, "nation"), SEARCH)


def enriched(spark, sf_dir) -> DataFrame:
    return _pick(table(spark, sf_dir, "customer"), ENRICHED)


# -- the same views as SQL ----------------------------------------------------------------------


def _columns(columns: dict[str, str]) -> str:
    return ",\n  ".join(f"{e} AS {n}" for n, e in columns.items())


def _select(columns: dict[str, str], source: str) -> str:
    # DuckDB has no date_add(date, int); adding an integer to a date does the same
    body = _columns(columns).replace("date_add(DATE '2024-01-01', CAST(id_mutation % 300 AS INT))", "(DATE '2024-01-01' + CAST(id_mutation % 300 AS INT))")
    return f"SELECT {body}\nFROM {source}"


SQL_VIEWS = {
    "tx": _select(TX, "lineitem JOIN part ON l_partkey = p_partkey"),
    "clean": """SELECT * EXCLUDE (rn),
  round_even(valeur_fonciere / surface_reelle_bati * 100, 0) / 100 AS prix_m2,
  CAST(year(date_mutation) AS INT) AS annee, CAST(month(date_mutation) AS INT) AS mois,
  CAST(quarter(date_mutation) AS INT) AS trimestre, CAST(CAST(code_postal AS BIGINT) % 100 AS INT) AS arrondissement
FROM (SELECT *, row_number() OVER (PARTITION BY id_mutation ORDER BY l_linenumber, l_partkey, l_suppkey, date_mutation, valeur_fonciere) AS rn
  FROM tx WHERE type_local IN ('Appartement', 'Maison') AND valeur_fonciere BETWEEN 10000 AND 30000000
    AND surface_reelle_bati BETWEEN 5 AND 1500 AND valeur_fonciere / surface_reelle_bati BETWEEN 2000 AND 50000)
WHERE rn = 1""",
    "train": "SELECT * FROM clean WHERE (id_mutation * 7919) % 100 < 80",
    "test": "SELECT * FROM clean WHERE (id_mutation * 7919) % 100 >= 80",
    "predictions": """SELECT t.*, m.prix_predit, t.prix_m2 AS prix_reel FROM test t
JOIN (SELECT arrondissement, avg(prix_m2) AS prix_predit FROM train GROUP BY arrondissement) m USING (arrondissement)""",
    "listings": _select(LISTING, "clean"),
    "listing_pages": _select(LISTING_PAGE, "listings"),
    "cards": _select(CARD, "listings"),
    "vision_answers": _select(VISION, "listings"),
    "requests": _select(REQUEST, "lineitem"),
    "places": _select(PLACE, "customer"),
    "searches": _select(SEARCH, "nation"),
    "enriched": _select(ENRICHED, "customer"),
}
_NEEDS = {
    "tx": [], "clean": ["tx"], "train": ["clean"], "test": ["clean"], "predictions": ["train", "test"],
    "listings": ["clean"], "listing_pages": ["listings"], "cards": ["listings"], "vision_answers": ["listings"],
    "requests": [], "places": [], "searches": [], "enriched": [],
}


def with_views(names: str, query: str) -> str:
    """Prefix ``query`` with the named views and those they need."""
    wanted: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS[name]:
            visit(need)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        visit(name)
    views = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in wanted)
    query = query.strip()
    joiner = ",\n" if query.upper().startswith("WITH ") else "\n"
    body = query[5:] if joiner == ",\n" else query
    return f"WITH {views}{joiner}{body}"
