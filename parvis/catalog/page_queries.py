"""Queries that read facts out of pages, cards and vision answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from parvis import constants as C
from parvis.catalog import views as V
from parvis.catalog.gem_queries import _FALLBACK, _points, ADJUSTED_SQL, FACTORS_SQL, PRICED_SQL
from parvis.catalog.registry import query
from parvis.functions import text as X
from parvis.functions.pricing import fallback_price_m2
from parvis.operators import extraction as E
from parvis.plans.listing_analysis import analyse_pages

AS_OF = "2024-12-01"


# -- helpers that write the same rule for DuckDB ----------------------------------------------


def _re(pattern: str) -> str:
    """The fixed pattern as a DuckDB literal (RE2 spells two things differently)."""
    text = pattern.replace("(?iu)", "(?i)").replace("\\" + "u00a0", r"\x{00a0}").replace("\\" + "u202f", r"\x{202f}")
    return "'" + text.replace("'", "''") + "'"


def _group(expr: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({expr}, {_re(pattern)}, {group}), '')"


_BLANKS = "' ' || chr(160) || chr(8239) || chr(9) || chr(10) || chr(13)"


def _number(expr: str) -> str:
    bare = f"translate(translate({expr}, {_BLANKS}, ''), ',', '.')"
    return rf"CASE WHEN regexp_full_match({bare}, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN TRY_CAST({bare} AS DOUBLE) END"


def _int(expr: str) -> str:
    return f"CAST(trunc({_number(expr)}) AS BIGINT)"


def _pos(expr: str) -> str:
    return f"(SELECT CASE WHEN v > 0 THEN v END FROM (SELECT {expr} AS v))"


def _unescape(expr: str) -> str:
    known = ", ".join(f"'{name}': chr({ord(char)})" for name, char in C.REFERENCES.items())
    name = r"regexp_extract(p, '^(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);', 1)"
    digits = f"CASE WHEN lower({name}) LIKE '#x%' THEN '0x' || substr({name}, 3) ELSE substr({name}, 2) END"
    number = f"TRY_CAST(CASE WHEN {name} LIKE '#%' THEN {digits} END AS INT)"
    char = f"coalesce(MAP {{{known}}}[{name}], CASE WHEN {number} BETWEEN 1 AND 55295 OR {number} BETWEEN 57344 AND 1114111 THEN chr({number}) END)"
    piece = f"CASE WHEN i = 1 THEN p ELSE coalesce({char} || substr(p, length({name}) + 2), '&' || p) END"
    return f"array_to_string(list_transform(string_split({expr}, '&'), lambda p, i: {piece}), '')"


def _text(html: str) -> str:
    out = f"regexp_replace({html}, '{X.MARKUP}', ' ', 'g')"
    plain = f"translate({_unescape(out)}, chr(160) || chr(8239) || chr(8201), '   ')"
    return rf"trim(regexp_replace({plain}, '[ \t\r\n\f]+', ' ', 'g'))"


def _meta(name: str) -> str:
    return f"""nullif(trim(coalesce({_group('html', f'(?is)<meta[^>]*(?:property|name)=["' + chr(39) + f']{name}["' + chr(39) + ']' + '[^>]*content="([^"]*)"')},
 {_group('html', '(?is)<meta[^>]*content="([^"]*)"[^>]*(?:property|name)=["' + chr(39) + f']{name}["' + chr(39) + ']')})), '')"""


# -- one rule per query ---------------------------------------------------------------------------

_URL_FIELDS = f"""CAST(CASE WHEN TRY_CAST({_group('url', C.URL_DISTRICT)} AS INT) BETWEEN 1 AND 20 THEN TRY_CAST({_group('url', C.URL_DISTRICT)} AS INT) END AS INT) AS url_arrondissement,
 {_group('url', C.URL_LISTING_ID)} AS listing_id,
 CASE WHEN contains(lower(url), 'appartement') THEN 'appartement' WHEN contains(lower(url), 'maison') THEN 'maison' END AS type_bien"""


@query(views="listing_pages", sql=f"SELECT page_id, {_URL_FIELDS} FROM listing_pages UNION ALL SELECT -page_id, {_URL_FIELDS} FROM pages")
def url_fields(spark, d):
    made = V.listing_pages(spark, d).select("page_id", "url")
    given = V.table(spark, d, "pages").select((-F.col("page_id")).alias("page_id"), "url")
    return E.url_fields(made.unionByName(given)).select("page_id", "url_arrondissement", "listing_id", "type_bien")


@query(views="listing_pages", sql=f"SELECT page_id, {_text('html')} AS text FROM pages UNION ALL SELECT -page_id, {_text('html')} FROM listing_pages")
def visible_text(spark, d):
    given = V.table(spark, d, "pages").select("page_id", "html")
    made = V.listing_pages(spark, d).select((-F.col("page_id")).alias("page_id"), "html")
    return given.unionByName(made).select("page_id", X.visible_text("html").alias("text"))


def _fields(spark, d, kind):
    """One source's fields under their plain names."""
    out = E.with_source(V.listing_pages(spark, d), kind)
    made = [c for c in out.columns if c.startswith(f"{kind}_")]
    return out.select("page_id", *[F.col(c).alias(c[len(kind) + 1:]) for c in made])


_LD_SQL = f"""ld_blocks AS (SELECT page_id, unnest(regexp_extract_all(html, {_re(C.JSONLD_BLOCK)}, 1)) AS b, generate_subscripts(regexp_extract_all(html, {_re(C.JSONLD_BLOCK)}, 1), 1) AS i FROM listing_pages),
ld_objects AS (SELECT page_id, i, CASE WHEN b LIKE '[%' THEN CAST(json_extract(b, '$[0]') AS STRING) ELSE b END AS o FROM ld_blocks),
ld_found AS (SELECT page_id, i, json_extract_string(o, '$.name') AS titre,
 {_int("coalesce(json_extract_string(o, '$.offers.price'), json_extract_string(o, '$.offers[0].price'))")} AS prix,
 {_number("coalesce(json_extract_string(o, '$.floorSize.value'), json_extract_string(o, '$.floorSize'))")} AS surface,
 {_int("json_extract_string(o, '$.numberOfRooms')")} AS pieces, {_int("json_extract_string(o, '$.address.postalCode')")} % 100 AS arrondissement,
 coalesce(json_extract_string(o, '$.datePublished'), json_extract_string(o, '$.dateCreated'), json_extract_string(o, '$.dateModified')) AS jour
 FROM ld_objects WHERE json_extract_string(o, '$."@type"') IN ('Apartment', 'House', 'RealEstateListing', 'Product')),
ld AS (SELECT page_id, arg_min(titre, i) FILTER (titre IS NOT NULL) AS titre, arg_min(prix, i) FILTER (prix > 0) AS prix, arg_min(surface, i) FILTER (surface > 0) AS surface,
 arg_min(pieces, i) FILTER (pieces > 0) AS pieces, arg_min(arrondissement, i) FILTER (arrondissement > 0) AS arrondissement, arg_min(jour, i) FILTER (jour IS NOT NULL) AS jour
 FROM ld_found GROUP BY page_id)"""
_OUT = "titre, CAST(prix AS BIGINT) AS prix, surface, CAST(pieces AS INT) AS pieces, CAST(arrondissement AS INT) AS arrondissement"


@query(
    views="listing_pages",
    sql=f"WITH {_LD_SQL} SELECT page_id, {_OUT}, jour AS date_publication FROM listing_pages LEFT JOIN ld USING (page_id)",
)
def jsonld_listing(spark, d):
    return _fields(spark, d, "ld")


_S = "json_extract_string(s, '$.props.pageProps.{}')"


def _attribute(key: str) -> str:
    many = "CAST(json_extract(s, '$.props.pageProps.ad.attributes[*]') AS JSON[])"
    one = f"list_filter({many}, lambda a: json_extract_string(a, '$.key') = '{key}')[1]"
    return f"coalesce(json_extract_string({one}, '$.value_label'), json_extract_string({one}, '$.value'))"


_STATE_SQL = f"""st AS (SELECT page_id, {_group('html', C.APP_STATE_BLOCK)} AS s FROM listing_pages),
state AS (SELECT page_id, coalesce({_S.format('ad.subject')}, {_S.format('listingData.title')}) AS titre,
 {_pos(_int(f"coalesce({_S.format('ad.price[0]')}, {_S.format('ad.price')}, {_S.format('listingData.price')})"))} AS prix,
 {_pos(_number(f"coalesce({_attribute('square')}, {_S.format('listingData.surfaceArea')})"))} AS surface,
 {_pos(_int(f"coalesce({_attribute('rooms')}, {_S.format('listingData.roomsQuantity')})"))} AS pieces,
 {_pos(_int(f"coalesce({_S.format('ad.location.zipcode')}, {_S.format('listingData.postalCode')})") + ' % 100')} AS arrondissement,
 {_number(f"coalesce({_S.format('ad.location.lat')}, {_S.format('listingData.blurInfo.position.lat')})")} AS latitude,
 {_number(f"coalesce({_S.format('ad.location.lng')}, {_S.format('listingData.blurInfo.position.lon')})")} AS longitude FROM st)"""


@query(views="listing_pages", sql=f"WITH {_STATE_SQL} SELECT page_id, {_OUT}, latitude, longitude FROM state")
def app_state_listing(spark, d):
    return _fields(spark, d, "state")


def _named(keys: list[str]) -> str:
    return "lower(key) IN (" + ", ".join(f"'{k}'" for k in keys) + ")"


_VALUE = "json_extract_string(value, '$')"
_IS_NUMBER = "type IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT', 'DOUBLE')"
_KEYS_SQL = f"""ks AS (SELECT page_id, coalesce({', '.join(f"CASE WHEN json_valid({_group('html', p)}) THEN {_group('html', p)} END" for p in C.STATE_BLOCKS)}) AS k FROM listing_pages),
kt AS (SELECT page_id, key, value, type, id, CASE WHEN {_IS_NUMBER} THEN TRY_CAST({_VALUE} AS DOUBLE) END AS v FROM ks, json_tree(ks.k)
 WHERE NOT regexp_matches(fullkey, '\\[([5-9]|\\d\\d+)\\]') AND NOT contains(fullkey, '][')),
keyed AS (SELECT page_id, CAST(trunc(arg_min(v, id) FILTER ({_named(C.KEYS_PRICE)} AND trunc(v) <> 0)) AS BIGINT) AS prix,
 arg_min(v, id) FILTER ({_named(C.KEYS_AREA)} AND v <> 0) AS surface, CAST(arg_min(v, id) FILTER ({_named(C.KEYS_ROOMS)} AND trunc(v) <> 0) AS BIGINT) AS pieces,
 arg_min({_int(_VALUE)} % 100, id) FILTER ({_named(C.KEYS_POSTCODE)} AND type <> 'OBJECT' AND type <> 'ARRAY' AND {_int(_VALUE)} % 100 <> 0) AS arrondissement,
 arg_min({_VALUE}, id) FILTER ({_named(C.KEYS_DATE)} AND type = 'VARCHAR' AND {_VALUE} <> '') AS jour FROM kt GROUP BY page_id)"""


@query(
    views="listing_pages",
    sql=f"WITH {_KEYS_SQL} SELECT page_id, CAST(prix AS BIGINT) AS prix, surface, CAST(pieces AS INT) AS pieces, CAST(arrondissement AS INT) AS arrondissement, jour AS date_publication FROM listing_pages LEFT JOIN keyed USING (page_id)",
)
def state_key_search(spark, d):
    return _fields(spark, d, "keys")


_REQUEST = f"""json_extract_string(json_extract_string('["' || {_group('html', C.REQUEST_STATE_BLOCK)} || '"]', '$[0]'), '$.app_cldp.data.classified.{{}}')"""
_REQUEST_SQL = f"""asked AS (SELECT page_id, {_pos(_int(f"coalesce({_REQUEST.format('price')}, {_REQUEST.format('Prix')})"))} AS prix,
 {_pos(_number(f"coalesce({_REQUEST.format('surface')}, {_REQUEST.format('Surface')})"))} AS surface,
 {_pos(_int(f"coalesce({_REQUEST.format('rooms')}, {_REQUEST.format('nbPieces')})"))} AS pieces FROM listing_pages)"""


@query(views="listing_pages", sql=f"WITH {_REQUEST_SQL} SELECT page_id, CAST(prix AS BIGINT) AS prix, surface, CAST(pieces AS INT) AS pieces FROM asked")
def request_state_listing(spark, d):
    return _fields(spark, d, "request")


def _district(expr: str) -> str:
    code = f"CAST({_group(expr, C.DISTRICT_POSTCODE)} AS INT) % 100"
    return f"coalesce(CASE WHEN {code} BETWEEN 1 AND 20 THEN {code} END, nullif(CAST({_group(expr, C.DISTRICT_ORDINAL)} AS INT), 0))"


_JOINED = f"translate(described, {_BLANKS}, '')"
_META_SQL = f"""mt AS (SELECT page_id, url, {_meta('og:title')} AS og, {_meta('description')} AS de, {_meta('og:description')} AS od,
 nullif(trim({_unescape(_group('html', '(?is)<title[^>]*>(.*?)</title>'))}), '') AS ti FROM listing_pages),
md AS (SELECT *, coalesce(de, od, og, ti) AS described FROM mt),
meta AS (SELECT page_id, coalesce(og, ti) AS titre,
 list_max(list_filter(list_transform(regexp_extract_all({_JOINED}, '(\\d+)', 1), lambda x: TRY_CAST(x AS BIGINT)), lambda x: x > 10000 AND x < 10000000)) AS prix,
 {_pos(_number(f'coalesce({_group("described", C.META_AREA)}, {_group("described", C.META_AREA_LOOSE)})'))} AS surface,
 {_pos(_int(f'coalesce({_group("og", C.META_ROOMS_SHORT)}, {_group("described", C.META_ROOMS_SHORT)}, {_group("described", C.TEXT_ROOMS)})'))} AS pieces,
 coalesce({_district('described')}, {_district('og')}, nullif(CAST({_group('url', C.URL_DISTRICT)} AS INT), 0)) AS arrondissement FROM md)"""


@query(views="listing_pages", sql=f"WITH {_META_SQL} SELECT page_id, {_OUT} FROM meta")
def meta_listing(spark, d):
    return _fields(spark, d, "meta")


_PLAIN_SQL = f"""tx_text AS (SELECT page_id, {_text('html')} AS t FROM listing_pages),
plain AS (SELECT page_id, {_pos(_int(_group('t', C.TEXT_PRICE)))} AS prix, {_pos(_number(_group('t', C.TEXT_AREA)))} AS surface,
 {_pos(_int(_group('t', C.TEXT_ROOMS)))} AS pieces,
 {_pos(f"CAST(coalesce({_group('t', C.DISTRICT_ORDINAL)}, {_group('t', C.DISTRICT_DIGITS)}) AS INT)")} AS arrondissement FROM tx_text)"""


@query(
    views="listing_pages",
    sql=f"WITH {_PLAIN_SQL} SELECT page_id, CAST(prix AS BIGINT) AS prix, surface, CAST(pieces AS INT) AS pieces, arrondissement FROM plain",
)
def plain_text_listing(spark, d):
    return _fields(spark, d, "text")


_SOURCE = """CASE WHEN contains(lower(url), 'seloger.com') THEN 'SeLoger' WHEN contains(lower(url), 'leboncoin.fr') THEN 'LeBonCoin'
 WHEN contains(lower(url), 'pap.fr') THEN 'PAP' WHEN contains(lower(url), 'bienici.com') THEN 'BienIci' ELSE 'Inconnu' END"""
_READS_STATE, _READS_TEXT = "source IN ('LeBonCoin', 'BienIci')", "source IN ('PAP', 'BienIci')"


def _chain(name: str, asked: bool = True) -> str:
    first = "CASE WHEN {r} THEN state.{n} END, ld.{n}, keyed.{n}, meta.{n}"
    missing = " OR ".join(f"coalesce({first.format(r=_READS_STATE, n=n)}) IS NULL" for n in ("prix", "surface"))
    late = f"CASE WHEN {missing} THEN asked.{name} END, " if asked else ""
    return f"coalesce({first.format(r=_READS_STATE, n=name)}, {late}CASE WHEN {_READS_TEXT} THEN plain.{name} END)"


_STAMP = "TRY_CAST(substr(jour, 1, 19) AS TIMESTAMP)"
_DAYS = f"CAST(floor((epoch(TIMESTAMP '{AS_OF} 00:00:00') - epoch({_STAMP})) / 86400) AS INT)"
_EXTRACT_SQL = f"""{_LD_SQL}, {_STATE_SQL}, {_KEYS_SQL}, {_META_SQL}, {_REQUEST_SQL}, {_PLAIN_SQL},
chained AS (SELECT page_id, html, url, source, coalesce(CASE WHEN {_READS_STATE} THEN state.titre END, ld.titre, meta.titre) AS titre,
 CAST({_chain('prix')} AS BIGINT) AS prix, {_chain('surface')} AS surface, CAST({_chain('pieces')} AS INT) AS pieces, CAST({_chain('arrondissement', asked=False)} AS INT) AS arrondissement,
 CASE WHEN {_READS_STATE} THEN latitude END AS latitude, CASE WHEN {_READS_STATE} THEN longitude END AS longitude,
 coalesce(ld.jour, keyed.jour, {', '.join(_group('html', p) for p in C.PAGE_DATES)}) AS jour
 FROM (SELECT *, {_SOURCE} AS source FROM listing_pages) p LEFT JOIN ld USING (page_id) LEFT JOIN state USING (page_id) LEFT JOIN keyed USING (page_id)
 LEFT JOIN meta USING (page_id) LEFT JOIN asked USING (page_id) LEFT JOIN plain USING (page_id)),
extracted AS (SELECT * EXCLUDE (jour), CAST(CASE WHEN {_DAYS} < 3650 THEN greatest({_DAYS}, 0) END AS INT) AS days_on_market FROM chained)"""
_EXTRACT_COLUMNS = ["page_id", "source", "titre", "prix", "surface", "pieces", "arrondissement", "latitude", "longitude", "days_on_market"]


@query(views="listing_pages", sql=f"WITH {_EXTRACT_SQL} SELECT {', '.join(_EXTRACT_COLUMNS)} FROM extracted")
def listing_extract(spark, d):
    return E.extract_listings(V.listing_pages(spark, d), F.lit(AS_OF)).select(*_EXTRACT_COLUMNS)


def _words(words: list[str]) -> str:
    return "list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(lower(t), w))"


def _charge(pattern: str) -> str:
    return f"(SELECT CASE WHEN v > 10 AND v < 5000 THEN v END FROM (SELECT {_int(_group('t', pattern))} AS v))"


_COMPASS = f"upper(translate({_group('t', C.EXPOSURE)}, ' -', ''))"
_FEATURES_SQL = f"""ft AS (SELECT page_id, html, {_text('html')} AS t FROM listing_pages),
fl AS (SELECT *, regexp_matches(t, {_re(C.GROUND_FLOOR)}) AS ground, regexp_matches(t, {_re(C.TOP_FLOOR)}) AS topf FROM ft),
feats AS (SELECT page_id,
 CAST(CASE WHEN ground THEN 0 WHEN topf THEN coalesce(TRY_CAST({_group('t', C.TOP_FLOOR_NUMBER)} AS INT), 6) ELSE TRY_CAST({_group('t', C.FLOOR_NUMBER)} AS INT) END AS INT) AS etage,
 CASE WHEN NOT ground AND NOT topf THEN TRY_CAST({_group('t', C.FLOOR_NUMBER, 2)} AS INT) END AS nb_etages,
 upper(coalesce({_group('t', C.ENERGY_CLASS)}, {_group('html', C.ENERGY_CLASS_ELEMENT)})) AS dpe_classe,
 round_even(len({_words(C.RENOVATION_WORDS)}) / 8.0e0 * 1000, 0) / 1000 AS renovation_score, round_even(len({_words(C.QUALITY_WORDS)}) / 7.0e0 * 1000, 0) / 1000 AS quality_score,
 CAST(coalesce({', '.join(_charge(p) for p in C.CHARGES)}) AS INT) AS charges_mensuelles,
 {', '.join(f"regexp_matches(t, {_re(p)}) AS {n}" for n, p in C.AMENITIES.items())},
 CASE {_COMPASS} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in C.EXPOSURES.items())} END AS exposition,
 array_to_string(list_concat({_words(C.RENOVATION_WORDS)}, {_words(C.QUALITY_WORDS)}), ',') AS words FROM fl)"""
_FEATURE_COLUMNS = [
    "page_id", "etage", "nb_etages", "dpe_classe", "renovation_score", "quality_score", "charges_mensuelles", *C.AMENITIES, "exposition",
]


@query(views="listing_pages", sql=f"WITH {_FEATURES_SQL} SELECT {', '.join(_FEATURE_COLUMNS)}, words FROM feats")
def listing_features(spark, d):
    known = F.array(*[F.lit(w) for w in [*C.RENOVATION_WORDS, *C.QUALITY_WORDS]])
    found = E.listing_features(V.listing_pages(spark, d))
    words = F.array_join(F.filter("features_found", lambda w: F.array_contains(known, w)), ",")
    return found.select(*_FEATURE_COLUMNS, words.alias("words"))


_SPOTS = _points(C.CENTROIDS)


_NO_VISION = """(SELECT CAST(NULL AS BIGINT) AS page_id, CAST(NULL AS INT) AS vision_score, CAST(NULL AS STRING) AS luminosite, CAST(NULL AS STRING) AS hauteur_plafond,
 CAST(NULL AS STRING) AS qualite_generale)"""


def analysis_sql(vision: str, price: str, joins: str = "", more: str = "") -> str:
    """Tables up to ``adjusted``: every page with its prices, also of incomplete pages."""
    return f"""{_EXTRACT_SQL}, {_FEATURES_SQL},
full_rows AS (SELECT e.page_id, concat_ws(',', CASE WHEN NOT coalesce(prix > 0, false) THEN 'prix' END, CASE WHEN NOT coalesce(surface > 0, false) THEN 'surface' END,
  CASE WHEN NOT coalesce(arrondissement BETWEEN 1 AND 20, false) THEN 'arrondissement' END) AS missing,
 prix AS prix_annonce, surface, coalesce(pieces, CASE WHEN surface IS NULL THEN NULL WHEN surface < 35 THEN 1 WHEN surface < 55 THEN 2 WHEN surface < 75 THEN 3 WHEN surface < 100 THEN 4 WHEN surface < 130 THEN 5
  ELSE greatest(6, CAST(round_even(surface / 22, 0) AS INT)) END) AS pieces, arrondissement, coalesce(CASE WHEN longitude IS NOT NULL THEN latitude END, clat, 48.8566e0) AS latitude,
 coalesce(CASE WHEN latitude IS NOT NULL THEN longitude END, clon, 2.3522e0) AS longitude, days_on_market, etage, dpe_classe, renovation_score, exposition, vision_score, luminosite, hauteur_plafond,
 qualite_generale, {more} {price} AS prix_m2_predit
 FROM extracted e JOIN feats USING (page_id) LEFT JOIN {_SPOTS} USING (arrondissement)
 LEFT JOIN {vision} USING (page_id) {joins}),
factors AS ({FACTORS_SQL.format(source='full_rows')}), priced AS ({PRICED_SQL}),
adjusted AS (SELECT priced.*, CASE WHEN missing = '' THEN 'complete' ELSE 'needs_input' END AS status, {ADJUSTED_SQL} FROM priced)"""


@query(
    views="listing_pages",
    sql=f"""WITH {analysis_sql(_NO_VISION, _FALLBACK)},
done AS (SELECT page_id, status, missing, CAST(pieces AS INT) AS pieces, latitude, longitude, prix_corrige_m2, prix_net_m2,
 negotiation_margin, gem_score, prix_predit_total, gain_potentiel FROM adjusted)
SELECT * REPLACE ({', '.join(f"CASE WHEN status = 'complete' THEN {c} END AS {c}" for c in ("prix_corrige_m2", "prix_net_m2", "gem_score", "prix_predit_total", "gain_potentiel"))}) FROM done""",
    digits={"prix_corrige_m2 prix_net_m2": 3, "gem_score latitude longitude": 6},
)
def listing_analysis(spark, d):
    done = analyse_pages(
        V.listing_pages(spark, d), F.lit(AS_OF), lambda x: x.withColumn("prix_m2_predit", fallback_price_m2("arrondissement"))
    )
    return done.select(
        "page_id", "status", F.array_join("missing", ",").alias("missing"), "pieces", "latitude", "longitude", "prix_corrige_m2",
        "prix_net_m2", "negotiation_margin", "gem_score", "prix_predit_total", "gain_potentiel",
    )


_MESSY = """CASE CAST(id_mutation % 6 AS INT) WHEN 0 THEN '1 234,5' WHEN 1 THEN CAST(id_mutation AS STRING) || ' 000' WHEN 2 THEN 'prix'
 WHEN 3 THEN '12d' WHEN 4 THEN CAST(id_mutation AS STRING) || '.75' ELSE NULL END"""


@query(
    views="clean",
    sql=f"SELECT id_mutation, coalesce({_int('m')}, 0) AS as_int, coalesce({_number('m')}, 0.0e0) AS as_float FROM (SELECT id_mutation, {_MESSY} AS m FROM clean)",
)
def number_parsing(spark, d):
    messy = V.clean(spark, d).select("id_mutation", F.expr(_MESSY).alias("m"))
    return messy.select("id_mutation", X.parse_int("m").alias("as_int"), X.parse_float("m").alias("as_float"))


_MAIN = _re("(?i)(" + C.PHOTO_PATTERNS[0] + ")")
_OTHER = _re("(?i)(" + C.PHOTO_PATTERNS[1] + ")")


@query(
    views="listing_pages",
    sql=f"""WITH ob AS (SELECT page_id, html, unnest(regexp_extract_all(html, {_re(C.JSONLD_BLOCK)}, 1)) AS b FROM listing_pages),
li AS (SELECT page_id, CAST(json_extract(CASE WHEN b LIKE '[%' THEN CAST(json_extract(b, '$[0]') AS STRING) ELSE b END, '$.image') AS STRING[]) AS u FROM ob),
plain AS (SELECT page_id, html, regexp_replace(html, '\\\\(/|u002[Ff])', '/', 'g') AS raw FROM listing_pages),
al AS (SELECT p.page_id, list_concat(list_concat([{_meta('og:image')}], coalesce(u, [])), list_concat(regexp_extract_all(raw, {_MAIN}, 1), regexp_extract_all(raw, {_OTHER}, 1))) AS urls
 FROM plain p LEFT JOIN li USING (page_id)),
un AS (SELECT page_id, unnest(urls) AS u, generate_subscripts(urls, 1) AS i FROM al),
ti AS (SELECT page_id, i, rtrim(split_part(u, '#', 1), chr(92) || '"''>,') AS u FROM un WHERE u IS NOT NULL),
ba AS (SELECT page_id, split_part(u, '?', 1) AS base, min(i) AS i, coalesce(arg_min(u, i) FILTER (contains(u, 'ci_seal')), arg_min(u, i)) AS u FROM ti WHERE u LIKE 'http%' GROUP BY 1, 2),
rk AS (SELECT page_id, u, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN contains(u, 'ci_seal') THEN 0 ELSE 1 END, i) AS r FROM ba)
SELECT page_id, coalesce(photos, '') AS photos FROM listing_pages LEFT JOIN (SELECT page_id, string_agg(u, ' ' ORDER BY r) AS photos FROM rk WHERE r <= 5 GROUP BY 1) USING (page_id)""",
)
def photo_urls(spark, d):
    return E.photo_urls(V.listing_pages(spark, d)).select("page_id", F.array_join("photos", " ").alias("photos"))


@query(
    views="listing_pages",
    sql=f"""WITH og AS (SELECT page_id, html, trim({_meta('og:image')}) AS o FROM listing_pages),
ob AS (SELECT page_id, unnest(regexp_extract_all(html, {_re(C.JSONLD_BLOCK)}, 1)) AS b, generate_subscripts(regexp_extract_all(html, {_re(C.JSONLD_BLOCK)}, 1), 1) AS i FROM listing_pages),
im AS (SELECT page_id, i, json_extract_string(CASE WHEN b LIKE '[%' THEN CAST(json_extract(b, '$[0]') AS STRING) ELSE b END, '$.image[0]') AS u FROM ob),
li AS (SELECT page_id, arg_min(u, i) AS u FROM im WHERE u LIKE 'http%' GROUP BY 1),
tg AS (SELECT page_id, list_filter(regexp_extract_all(html, '<img[^>]* src="([^"]*)"', 1), lambda u: u LIKE 'http%' AND regexp_matches(lower(u), '{"|".join(C.PHOTO_HINTS)}'))[1] AS u FROM listing_pages)
SELECT page_id, coalesce(CASE WHEN o LIKE 'http%' THEN o END, li.u, tg.u) AS photo_url FROM og LEFT JOIN li USING (page_id) LEFT JOIN tg USING (page_id)""",
)
def first_photo(spark, d):
    return E.first_photo(V.listing_pages(spark, d)).select("page_id", "photo_url")


_NAMED = "CASE " + " ".join(
    f"WHEN contains(title, '{i}e') OR contains(lower(title), '{i}ème') OR contains(title, '75{i:03d}') THEN {i}" for i in range(1, 21)
) + " ELSE 11 END"


@query(
    views="cards",
    sql=f"""SELECT * FROM (SELECT id_mutation, coalesce(TRY_CAST(regexp_replace(price_text, '[^0-9]', '', 'g') AS BIGINT), 0) AS prix_annonce,
 coalesce(TRY_CAST(nullif(regexp_replace(split_part(surface_text, 'm²', 1), '[^0-9.]', '', 'g'), '') AS DOUBLE), 50.0e0) AS surface, CAST({_NAMED} AS INT) AS arrondissement FROM cards)
WHERE prix_annonce >= 50000""",
)
def card_parsing(spark, d):
    return E.parse_cards(V.cards(spark, d)).select("id_mutation", "prix_annonce", "surface", "arrondissement")


_VISION_SQL = """vb AS (SELECT listing_id, photo_index, nullif(regexp_extract(raw, '(?s)(\\{.*\\})', 1), '') AS b FROM vision_answers),
vp AS (SELECT listing_id, photo_index, CASE WHEN json_valid(b) THEN b END AS b FROM vb),
vs AS (SELECT listing_id, photo_index, CAST(least(greatest(coalesce(CASE WHEN json_type(b, '$.renovation_score') <> 'VARCHAR' OR regexp_full_match(json_extract_string(b, '$.renovation_score'), ' *[+-]?[0-9]+ *')
 THEN trunc(TRY_CAST(json_extract_string(b, '$.renovation_score') AS DOUBLE)) END, 3), 1), 5) AS INT) AS renovation_score,
 coalesce(json_extract_string(b, '$.has_outdoor_space') NOT IN ('false', '0', ''), false) AS has_outdoor_space, coalesce(json_extract_string(b, '$.reasoning'), '') AS reasoning,
 b IS NOT NULL AS parsed, CASE WHEN json_extract_string(b, '$.space_category') IN ('Étroit', 'Standard', 'Spacieux') THEN json_extract_string(b, '$.space_category') ELSE 'Standard' END AS space_category,
 CASE WHEN json_extract_string(b, '$.luminosite') IN ('Sombre', 'Moyenne', 'Lumineuse') THEN json_extract_string(b, '$.luminosite') ELSE 'Moyenne' END AS luminosite,
 CASE WHEN json_extract_string(b, '$.hauteur_plafond') IN ('Basse', 'Standard', 'Haute') THEN json_extract_string(b, '$.hauteur_plafond') ELSE 'Standard' END AS hauteur_plafond,
 CASE WHEN json_extract_string(b, '$.qualite_generale') IN ('Basique', 'Standard', 'Premium') THEN json_extract_string(b, '$.qualite_generale') ELSE 'Standard' END AS qualite_generale FROM vp)"""


@query(views="vision_answers", sql=f"WITH {_VISION_SQL} SELECT * FROM vs")
def vision_normalise(spark, d):
    return E.normalise_vision(V.vision_answers(spark, d)).drop("raw")


@query(
    views="vision_answers",
    sql=f"""WITH {_VISION_SQL} SELECT listing_id, CAST(round_even(avg(renovation_score), 0) AS INT) AS renovation_score, arg_min(space_category, photo_index) AS space_category,
 arg_min(luminosite, photo_index) AS luminosite, arg_min(hauteur_plafond, photo_index) AS hauteur_plafond, arg_min(has_outdoor_space, photo_index) AS has_outdoor_space,
 arg_min(qualite_generale, photo_index) AS qualite_generale, count(*) AS photos_analyzed FROM vs GROUP BY listing_id""",
)
def vision_by_listing(spark, d):
    return E.vision_by_listing(V.vision_answers(spark, d))


_OLD = "CAST(CAST(date_mutation AS DATE) AS STRING) || CASE WHEN id_mutation % 3 = 0 THEN 'T13:45:10+02:00' WHEN id_mutation % 3 = 1 THEN 'T23:59:59' ELSE '' END"


@query(
    views="clean",
    sql=f"""SELECT id_mutation, CAST(CASE WHEN v < 3650 THEN greatest(v, 0) END AS INT) AS days FROM (SELECT id_mutation,
 CAST(floor((epoch(TIMESTAMP '2001-06-01 00:00:00') - epoch(TRY_CAST(substr({_OLD}, 1, 19) AS TIMESTAMP))) / 86400) AS INT) AS v FROM clean)""",
)
def days_on_market(spark, d):
    dated = V.clean(spark, d).select("id_mutation", F.expr(_OLD).alias("published"))
    return dated.select("id_mutation", X.days_since("published", F.lit("2001-06-01")).alias("days"))


@query(
    views="clean",
    sql="""SELECT id_mutation, adresse_numero || ' ' || array_to_string(list_transform(string_split(lower(adresse_nom_voie), ' '), lambda w: upper(w[1]) || w[2:]), ' ')
 || ' Paris ' || arrondissement || CASE WHEN arrondissement = 1 THEN 'er' ELSE 'e' END AS adresse FROM clean""",
)
def address_label(spark, d):
    from parvis.functions.geo import district

    return V.clean(spark, d).select("id_mutation", X.address_label("adresse_numero", "adresse_nom_voie", district()).alias("adresse"))


# contributions of a hand-made additive price, whole numbers so that both engines print them alike
_PARTS = {
    "log_surface": "CAST((id_mutation * 37) % 1000 - 500 AS DOUBLE)",
    "arr_target_enc": "CAST((id_mutation * 91) % 3000 - 1200 AS DOUBLE)",
    "dist_center_km": "CAST(-(id_mutation % 700) AS DOUBLE)",
    "annee": "CAST(id_mutation % 17 - 8 AS DOUBLE)",
}


def _contributions(spark, d):
    parts = [F.struct(F.lit(n).alias("feature"), F.expr(e).alias("value"), F.lit(C.FEATURE_LABELS[n]).alias("display")) for n, e in _PARTS.items()]
    return V.clean(spark, d).select("id_mutation", "prix_m2", F.col("code_postal"), X.top_contributions(F.array(*parts), 3).alias("top"))


_PARTS_SQL = " UNION ALL ".join(f"SELECT id_mutation, '{n}' AS feature, {e} AS value, '{C.FEATURE_LABELS[n]}' AS display FROM clean" for n, e in _PARTS.items())
_TOP_SQL = f"""top AS (SELECT *, row_number() OVER (PARTITION BY id_mutation ORDER BY abs(value) DESC, feature) AS r FROM ({_PARTS_SQL}))"""


@query(views="clean", sql=f"WITH {_TOP_SQL} SELECT id_mutation, string_agg(feature, ',' ORDER BY r) AS features FROM top WHERE r <= 3 GROUP BY 1")
def top_contributions(spark, d):
    return _contributions(spark, d).select("id_mutation", F.array_join(F.transform("top", lambda c: c["feature"]), ",").alias("features"))


_MONEY = "format('{{:,.0f}}', {})"


@query(
    views="clean",
    sql=f"""WITH {_TOP_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY id_mutation, value > 0 ORDER BY r) AS q FROM top WHERE r <= 3 AND value <> 0),
p AS (SELECT id_mutation, string_agg('**' || display || '** (' || CASE WHEN value > 0 THEN '+' ELSE '' END || {_MONEY.format('value')} || ' €/m²)', ', ' ORDER BY r) FILTER (value > 0 AND q <= 2) AS plus,
 string_agg('**' || display || '** (' || {_MONEY.format('value')} || ' €/m²)', ', ' ORDER BY r) FILTER (value < 0 AND q <= 2) AS minus FROM s GROUP BY 1)
SELECT c.id_mutation, 'Ce bien dans le ' || arrondissement || CASE WHEN arrondissement = 1 THEN 'er' ELSE 'e' END || ' arrondissement (à 2.5 km du centre) est estimé à **'
 || {_MONEY.format('floor(prix_m2)')} || ' €/m²**.' || coalesce(' Facteurs valorisants : ' || plus || '.', '') || coalesce(' Facteurs pénalisants : ' || minus || '.', '') AS xai_summary
FROM clean c LEFT JOIN p ON c.id_mutation = p.id_mutation""",
)
def explanation_sentence(spark, d):
    from parvis.functions.geo import district

    rows = _contributions(spark, d)
    return rows.select("id_mutation", X.explanation(F.floor("prix_m2"), "top", district(), F.lit(2.5)).alias("xai_summary"))
