"""Listing facts from tables of pages, cards and vision answers.

Every extraction is a set of column expressions over one row, so a job over any
number of pages is a scan with projections: no shuffle, no Python. Costly steps
(a scan of the page, a JSON parse) become columns of their own, written once and
read by the projections after them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parvis import constants as C
from parvis.functions import text as X
from parvis.functions.json_search import FIELDS, key_search
from parvis.functions.numbers import lookup, round_even

# a single object is read as a list of one
LD_SCHEMA = (
    "array<struct<`@type`:string,name:string,offers:string,floorSize:string,numberOfRooms:string,address:string,"
    "datePublished:string,dateCreated:string,dateModified:string,image:string>>"
)
_AD = (
    "subject:string,price:string,attributes:array<struct<key:string,value:string,value_label:string>>,"
    "location:struct<zipcode:string,lat:string,lng:string>"
)
_LISTING_DATA = (
    "title:string,name:string,price:string,surfaceArea:string,surface:string,roomsQuantity:string,rooms:string,"
    "postalCode:string,zipCode:string,blurInfo:struct<position:struct<lat:string,lon:string>>"
)
STATE_SCHEMA = f"props struct<pageProps:struct<ad:struct<{_AD}>,listingData:struct<{_LISTING_DATA}>>>"


def url_fields(df: DataFrame, url: str = "url") -> DataFrame:
    number, low = F.col("_district"), F.lower(F.col(url))
    return (
        df.withColumns(
            {"_district": X.first_group(url, C.URL_DISTRICT).try_cast("int"), "_id": X.first_group(url, C.URL_LISTING_ID)}
        )
        .withColumns(
            {
                "url_arrondissement": F.when(number.between(1, 20), number),
                "listing_id": X.blank_to_null(F.col("_id")),
                "type_bien": F.when(low.contains("appartement"), "appartement").when(low.contains("maison"), "maison"),
            }
        )
        .drop("_district", "_id")
    )


# -- structured blocks ------------------------------------------------------------------

Fields = dict[str, Column]


def _first(array: Column, pick: Callable[[Column], Column], keep: Callable[[Column], Column] | None = None) -> Column:
    """First usable result of ``pick`` over an array."""
    keep = keep or (lambda x: x.isNotNull())
    return F.try_element_at(F.filter(F.transform(array, pick), keep), F.lit(1))


def _above_zero(x: Column) -> Column:
    return x > 0


def _inner(raw: Column, field: str) -> Column:
    """A field of an object, or of the first object of a list, given as raw JSON."""
    return F.get(F.from_json(raw, f"array<struct<{field}:string>>"), F.lit(0))[field]


def _scalar(raw: Column) -> Column:
    """A scalar given as such or as the first entry of a list."""
    return F.regexp_extract(raw, r'^\[?\s*"?([^",\]]*)', 1)


def jsonld_objects(html) -> Column:
    """Parsed JSON-LD objects of a page; of a list only the first element counts."""
    blocks = F.regexp_extract_all(F.col(html), F.lit(C.JSONLD_BLOCK), F.lit(1))
    return F.filter(F.transform(blocks, lambda b: F.get(F.from_json(b, LD_SCHEMA), F.lit(0))), lambda o: o.isNotNull())


def jsonld_fields(objects: Column) -> Fields:
    ads = F.filter(objects, lambda o: o["@type"].isin(C.LISTING_TYPES))

    def area(o: Column) -> Column:
        return X.parse_float(F.when(o["floorSize"].startswith("{"), _inner(o["floorSize"], "value")).otherwise(o["floorSize"]))

    return {
        "titre": _first(ads, lambda o: o["name"], lambda x: x != ""),
        "prix": _first(ads, lambda o: X.parse_int(_inner(o["offers"], "price")), _above_zero),
        "surface": _first(ads, area, _above_zero),
        "pieces": _first(ads, lambda o: X.parse_int(o["numberOfRooms"]), _above_zero),
        "arrondissement": _first(ads, lambda o: X.district_from_code(_inner(o["address"], "postalCode")), _above_zero),
        "date_publication": _first(ads, lambda o: F.coalesce(o["datePublished"], o["dateCreated"], o["dateModified"])),
    }


def app_state(html) -> Column:
    """The page's embedded application state, parsed once."""
    return F.from_json(X.first_group(html, C.APP_STATE_BLOCK), STATE_SCHEMA)["props"]["pageProps"]


def app_state_fields(state: Column) -> Fields:
    """Raw values of the two known shapes."""
    ad, data = state["ad"], state["listingData"]

    def attribute(key: str) -> Column:
        return _first(ad["attributes"], lambda a: F.when(a["key"] == key, F.coalesce(a["value_label"], a["value"])))

    position = data["blurInfo"]["position"]
    return {
        "titre": F.coalesce(ad["subject"], data["title"], data["name"]),
        "prix": X.parse_int(_scalar(F.coalesce(ad["price"], data["price"]))),
        "surface": X.parse_float(F.coalesce(attribute("square"), data["surfaceArea"], data["surface"])),
        "pieces": X.parse_int(F.coalesce(attribute("rooms"), data["roomsQuantity"], data["rooms"])),
        "arrondissement": X.district_from_code(F.coalesce(ad["location"]["zipcode"], data["postalCode"], data["zipCode"])),
        "latitude": X.parse_number(F.coalesce(ad["location"]["lat"], position["lat"])),
        "longitude": X.parse_number(F.coalesce(ad["location"]["lng"], position["lon"])),
    }


def state_texts(html) -> Column:
    """Texts of the state objects of the page's scripts, by the patterns in order; null where there is none."""
    return F.filter(F.array(*[X.first_group(html, p) for p in C.STATE_BLOCKS]), lambda s: s != "")


def key_search_fields(found: Column) -> Fields:
    """First value of each known key name anywhere in the first state object that can be read."""
    return {name: found[name] for name in FIELDS}


REQUEST_SCHEMA = "app_cldp struct<data:struct<classified:map<string,string>>>"  # a map, since names differ by case alone


def string_literal(body: Column) -> Column:
    r"""What a script's string literal says, given what stands between its quotes.

    ``\xHH`` becomes ``\u00HH``, then it is read as a JSON string, which undoes all other
    escapes, pairs of ``\u`` surrogates included; null if it cannot be read.
    """
    plain = F.regexp_replace(body, r"(?<!\\)((?:\\\\)*)\\x([0-9A-Fa-f]{2})", r"$1\\u00$2")
    options = {"allowBackslashEscapingAnyCharacter": "true", "allowUnquotedControlChars": "true"}
    return F.get(F.from_json(F.concat(F.lit('["'), plain, F.lit('"]')), "array<string>", options), F.lit(0))


def request_state(html) -> Column:
    """The listing in the state a page's script parses from a string literal, as a map of raw values."""
    body = X.first_group(html, C.REQUEST_STATE_BLOCK)
    return F.from_json(string_literal(body), REQUEST_SCHEMA)["app_cldp"]["data"]["classified"]


def request_state_fields(classified: Column) -> Fields:
    def either(one: str, other: str) -> Column:
        return F.coalesce(F.try_element_at(classified, F.lit(one)), F.try_element_at(classified, F.lit(other)))

    return {
        "prix": X.parse_int(either("price", "Prix")),
        "surface": X.parse_float(either("surface", "Surface")),
        "pieces": X.parse_int(either("rooms", "nbPieces")),
    }


# -- meta tags and plain text --------------------------------------------------------------


def _first_text(*cols: Column) -> Column:
    return F.try_element_at(F.filter(F.array(*cols), lambda x: x != ""), F.lit(1))


def meta_fields(tags: Column, title: Column, url: Column) -> Fields:
    og_title = X.meta_content(tags, "og:title")
    described = _first_text(X.meta_content(tags, "description"), X.meta_content(tags, "og:description"), og_title, title)
    return {"titre": _first_text(og_title, title), "og": og_title, "described": described, "from_url": X.first_group(url, C.URL_DISTRICT)}


def meta_values(og: Column, described: Column, from_url: Column) -> Fields:
    def districts(text: Column) -> list[Column]:
        code = F.pmod(X.first_group(text, C.DISTRICT_POSTCODE).try_cast("int"), F.lit(100))
        code = F.try_element_at(F.filter(F.array(code), lambda x: x.between(1, 20)), F.lit(1))
        return [code, X.first_group(text, C.DISTRICT_ORDINAL).try_cast("int")]

    candidates = [*districts(described), *districts(og), from_url.try_cast("int")]
    return {
        "prix": X.largest_number(described, *C.META_PRICE_RANGE),
        "surface": X.parse_float(_first_text(X.first_group(described, C.META_AREA), X.first_group(described, C.META_AREA_LOOSE))),
        "pieces": X.parse_int(
            _first_text(
                X.first_group(og, C.META_ROOMS_SHORT), X.first_group(described, C.META_ROOMS_SHORT), X.first_group(described, C.TEXT_ROOMS)
            )
        ),
        "arrondissement": F.try_element_at(F.filter(F.array(*candidates), _above_zero), F.lit(1)),
    }


def text_fields(text: Column) -> Fields:
    return {
        "prix": X.parse_int(X.first_group(text, C.TEXT_PRICE)),
        "surface": X.parse_float(X.first_group(text, C.TEXT_AREA)),
        "pieces": X.parse_int(X.first_group(text, C.TEXT_ROOMS)),
        "arrondissement": _first_text(
            X.first_group(text, C.DISTRICT_ORDINAL), X.first_group(text, C.DISTRICT_DIGITS)
        ).try_cast("int"),
    }


TYPES = {
    "titre": "string", "prix": "bigint", "surface": "double", "pieces": "int", "arrondissement": "int",
    "date_publication": "string", "latitude": "double", "longitude": "double",
}


def _tidied(prefix: str, fields: Fields) -> Fields:
    """Zero, negative and empty mean "not found"; coordinates are kept as they are."""
    out = {}
    for name in fields:
        col, kind = F.col(f"{prefix}{name}"), TYPES[name]
        if name in ("latitude", "longitude"):
            out[f"{prefix}{name}"] = col
        else:
            out[f"{prefix}{name}"] = (X.blank_to_null(col) if kind == "string" else X.positive(col)).cast(kind)
    return out


def with_source(df: DataFrame, kind: str, html: str = "html", url: str = "url") -> DataFrame:
    """Add one source's fields, prefixed with its name: ``state_``, ``ld_``,
    ``keys_``, ``meta_``, ``request_`` or ``text_``."""
    prefix = f"{kind}_"
    if kind == "state":
        df, fields = df.withColumn("_block", app_state(html)), app_state_fields(F.col("_block"))
    elif kind == "ld":
        df, fields = df.withColumn("_block", jsonld_objects(html)), jsonld_fields(F.col("_block"))
    elif kind == "keys":
        df, fields = df.withColumn("_block", key_search(state_texts(html))), key_search_fields(F.col("_block"))
    elif kind == "request":
        df, fields = df.withColumn("_block", request_state(html)), request_state_fields(F.col("_block"))
    elif kind == "text":
        df = df.withColumn("_block", X.visible_text(html))
        fields = text_fields(F.col("_block"))
    else:
        df = df.withColumns({"_block": X.meta_tags(html), "_title": X.page_title(html)})
        found = meta_fields(F.col("_block"), F.col("_title"), F.col(url))
        df = df.withColumns({f"_m_{n}": c for n, c in found.items()})
        fields = {"titre": F.col("_m_titre"), **meta_values(F.col("_m_og"), F.col("_m_described"), F.col("_m_from_url"))}
    df = df.withColumns({f"{prefix}{n}": c for n, c in fields.items()})
    df = df.withColumns(_tidied(prefix, fields))
    return df.drop("_block", "_title", "_m_titre", "_m_og", "_m_described", "_m_from_url")


def extract_listings(pages: DataFrame, as_of: Column, html: str = "html", url: str = "url") -> DataFrame:
    """One listing per page. Sources are tried in a fixed order and a field is
    filled by the first that has it: application state, JSON-LD, state keys, meta
    tags, the state in a string literal if price or area are still missing, and the
    visible text. State and text are only read for the sites that need them."""
    out = pages.withColumn("source", X.host_source(url))
    reads_state = F.col("source").isin("LeBonCoin", "BienIci")
    reads_text = F.col("source").isin("PAP", "BienIci")
    out = out.withColumns({"_state_html": F.when(reads_state, F.col(html)), "_text_html": F.when(reads_text, F.col(html))})
    kinds = ["state", "ld", "keys", "meta", "request", "text"]
    for kind in kinds:
        out = with_source(out, kind, {"state": "_state_html", "text": "_text_html"}.get(kind, html), url)
    out = out.withColumns({f"_date{i}": X.first_group(html, p) for i, p in enumerate(C.PAGE_DATES)})

    def first(name: str, sources=("ld", "keys", "meta")) -> Column:
        return F.coalesce(F.col(f"state_{name}"), *[F.col(f"{s}_{name}") for s in sources])

    unfinished = first("prix").isNull() | first("surface").isNull()

    def chosen(name: str) -> Column:
        asked = [F.when(unfinished, F.col(f"request_{name}"))] if name in ("prix", "surface", "pieces") else []
        return F.coalesce(first(name), *asked, F.col(f"text_{name}"))

    dates = [X.blank_to_null(F.col(f"_date{i}")) for i in range(len(C.PAGE_DATES))]
    fields = {name: chosen(name) for name in ("prix", "surface", "pieces", "arrondissement")}
    fields["titre"] = first("titre", ("ld", "meta"))
    fields["latitude"], fields["longitude"] = F.col("state_latitude"), F.col("state_longitude")
    fields["_date"] = F.coalesce("ld_date_publication", "keys_date_publication", *dates)
    made = [c for c in out.columns if c.split("_")[0] in kinds and c not in pages.columns]
    return (
        out.withColumns(fields)
        .withColumn("days_on_market", X.days_since("_date", as_of))
        .drop(*made, "_state_html", "_text_html", "_date", *[f"_date{i}" for i in range(len(C.PAGE_DATES))])
    )


# -- qualitative features -------------------------------------------------------------------


def listing_features(pages: DataFrame, html: str = "html") -> DataFrame:
    """Floor, energy class, keyword scores, charges, amenities and exposure."""
    t = F.col("_text")
    low, high = C.CHARGES_RANGE
    captured = {
        "_ground": t.rlike(C.GROUND_FLOOR),
        "_top": t.rlike(C.TOP_FLOOR),
        "_top_no": X.first_group(t, C.TOP_FLOOR_NUMBER).try_cast("int"),
        "_floor_no": X.first_group(t, C.FLOOR_NUMBER).try_cast("int"),
        "_floors": X.first_group(t, C.FLOOR_NUMBER, 2).try_cast("int"),
        "_energy": _first_text(X.first_group(t, C.ENERGY_CLASS), X.first_group(html, C.ENERGY_CLASS_ELEMENT)),
        "_compass": F.upper(F.translate(X.first_group(t, C.EXPOSURE), " -", "")),
        "_renovation": X.words_found("_low", C.RENOVATION_WORDS),
        "_quality": X.words_found("_low", C.QUALITY_WORDS),
        "_charges": F.filter(
            F.array(*[X.parse_int(X.first_group(t, p), None) for p in C.CHARGES]), lambda v: (v > low) & (v < high)
        ),
    }
    ground, top = F.col("_ground"), F.col("_top")
    features = {
        "etage": F.when(ground, 0).when(top, F.coalesce("_top_no", F.lit(C.TOP_FLOOR_DEFAULT))).otherwise(F.col("_floor_no")),
        "nb_etages": F.when(~ground & ~top, F.col("_floors")),
        "dpe_classe": F.upper("_energy"),
        "renovation_score": round_even(F.size("_renovation") / F.lit(float(len(C.RENOVATION_WORDS))), 3),
        "quality_score": round_even(F.size("_quality") / F.lit(float(len(C.QUALITY_WORDS))), 3),
        "charges_mensuelles": F.try_element_at("_charges", F.lit(1)).cast("int"),
        **{name: t.rlike(pattern) for name, pattern in C.AMENITIES.items()},
        "exposition": lookup(F.col("_compass"), C.EXPOSURES),
    }
    out = pages.withColumn("_text", X.visible_text(html)).withColumn("_low", F.lower("_text"))
    out = out.withColumns(captured).withColumns(features)
    return out.withColumn("features_found", _found()).drop("_text", "_low", *captured)


def _found() -> Column:
    """Readable list of what was detected."""
    floor = (
        F.when(F.col("etage") == 0, "RDC")
        .when(F.col("_top"), F.concat(F.lit("Dernier étage "), F.col("etage").cast("string")))
        .when(F.col("nb_etages").isNotNull(), F.concat(F.lit("Étage "), F.col("etage").cast("string"), F.lit("/"), F.col("nb_etages").cast("string")))
        .when(F.col("etage").isNotNull(), F.concat(F.lit("Étage "), F.col("etage").cast("string")))
    )
    single = F.array_compact(F.array(floor, F.concat(F.lit("DPE "), F.col("dpe_classe"))))
    rest = F.array_compact(
        F.array(
            F.concat(F.lit("Charges "), F.col("charges_mensuelles").cast("string"), F.lit(" €/mois")),
            F.when(F.col("has_balcon"), "Balcon"),
            F.when(F.col("has_terrasse"), "Terrasse"),
            F.when(F.col("has_parking"), "Parking/Box"),
            F.when(F.col("has_cave"), "Cave"),
            F.concat(F.lit("Exposition "), F.col("exposition")),
        )
    )
    return F.concat(single, "_renovation", "_quality", rest)


# -- photos, cards, vision ----------------------------------------------------------------------


def slashes(text: Column) -> Column:
    r"""Slashes written as ``\/`` or ``\u002F`` undone."""
    return F.regexp_replace(text, r"\\(?:/|u002[Ff])", "/")


def _images(o: Column) -> Column:
    """Image addresses of a JSON-LD object: texts, or objects that name one."""
    entries = F.when(o["image"].startswith("["), F.from_json(o["image"], "array<string>")).otherwise(F.array(o["image"]))
    return F.transform(entries, lambda i: F.when(i.startswith("{"), F.coalesce(_inner(i, "url"), _inner(i, "contentUrl"))).otherwise(i))


def first_photo(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``photo_url``: the og:image, else the first image of a JSON-LD object, else the first
    image tag whose address looks like a listing photo's; null if there is none. Only addresses
    that begin with http count."""
    def web(u: Column) -> Column:
        return F.when(u.startswith("http"), u)

    tags = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<img\b[^>]*?\ssrc\s*=\s*["']([^"']*)["']"""), F.lit(1))
    hinted = F.filter("_tags", lambda u: u.startswith("http") & F.lower(u).rlike("|".join(C.PHOTO_HINTS)))
    return (
        pages.withColumns({"_ld": jsonld_objects(html), "_tags": tags, "_og": F.trim(X.meta_content(X.meta_tags(html), "og:image"))})
        .withColumn("_first", _first(F.col("_ld"), lambda o: web(F.get(_images(o), F.lit(0)))))
        .withColumn("photo_url", F.coalesce(web(F.col("_og")), "_first", F.try_element_at(hinted, F.lit(1))))
        .drop("_ld", "_tags", "_og", "_first")
    )


def photo_urls(pages: DataFrame, html: str = "html", limit: int = C.MAX_PHOTOS) -> DataFrame:
    """Add ``photos``: distinct photo addresses of a page, sealed variants first.

    Addresses are the same photo when equal up to ``?``; of those a sealed one
    is preferred, else the first. All per row, without a shuffle.
    """
    def base(u: Column) -> Column:
        return F.substring_index(u, "?", 1)

    def is_sealed(u: Column) -> Column:
        return u.contains(C.PHOTO_SEAL)

    plain = slashes(F.col(html))
    from_hosts = [F.regexp_extract_all("_plain", F.lit("(?i)(" + p + ")"), F.lit(1)) for p in C.PHOTO_PATTERNS]
    found = F.concat(F.array(X.meta_content(X.meta_tags(html), "og:image")), F.flatten(F.transform("_ld", _images)), *from_hosts)
    tidy = F.transform(
        F.filter("_found", lambda u: u.isNotNull()),
        lambda u: F.rtrim(F.substring_index(slashes(F.trim(u)), "#", 1), F.lit("\\\"'>,")),
    )
    urls, sealed = F.col("_urls"), F.col("_sealed")

    def best(b: Column) -> Column:
        return F.try_element_at(
            F.concat(F.filter(sealed, lambda u: base(u) == b), F.filter(urls, lambda u: base(u) == b)), F.lit(1)
        )

    return (
        pages.withColumns({"_plain": plain, "_ld": jsonld_objects(html)})
        .withColumn("_found", found)
        .withColumn("_urls", F.filter(tidy, lambda u: u.startswith("http")))
        .withColumn("_sealed", F.filter(urls, is_sealed))
        .withColumn("_best", F.transform(F.array_distinct(F.transform(urls, base)), best))
        .withColumn("photos", F.slice(F.concat(F.filter("_best", is_sealed), F.filter("_best", lambda u: ~is_sealed(u))), 1, limit))
        .drop("_plain", "_ld", "_found", "_urls", "_sealed", "_best")
    )


def parse_cards(cards: DataFrame, title="title", price="price_text", area="surface_text") -> DataFrame:
    """Result cards: digits of the price, area before "m²", district named in the title.

    The district is the smallest number whose ordinal or postcode appears in the
    title. Cards under the minimum price are dropped.
    """
    digits = F.coalesce(F.regexp_replace(price, r"[^0-9]", "").try_cast("bigint"), F.lit(0))
    before = F.regexp_replace(F.substring_index(F.col(area), "m²", 1), r"[^0-9.]", "")
    t = F.col(title)
    named = [
        F.when(t.contains(f"{i}e") | F.lower(t).contains(f"{i}ème") | t.contains(f"75{i:03d}"), i) for i in range(1, 21)
    ]
    return cards.select(
        "*",
        F.substring(t, 1, 80).alias("titre"),
        digits.alias("prix_annonce"),
        F.coalesce(X.parse_number(before), F.lit(C.CARD_DEFAULTS["surface"])).alias("surface"),
        F.coalesce(*named, F.lit(C.CARD_DEFAULTS["arrondissement"])).alias("arrondissement"),
        F.lit(C.CARD_DEFAULTS["pieces"]).alias("pieces"),
    ).where(F.col("prix_annonce") >= C.MIN_CARD_PRICE)


VISION_SCHEMA = (
    "renovation_score string, space_category string, luminosite string, hauteur_plafond string,"
    " has_outdoor_space string, qualite_generale string, reasoning string"
)


def normalise_vision(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Fields of raw vision answers: the outermost object (without code fences) parsed,
    score clamped, unknown categories replaced; unreadable answers get defaults."""
    low, high = C.VISION_SCORE_RANGE
    parsed = answers.withColumn("_body", X.first_group(raw, r"(?s)(\{.*\})")).withColumns(
        # a broken object reads as null as a whole, not field by field
        {"parsed": F.try_parse_json("_body").isNotNull(), "_v": F.from_json("_body", VISION_SCHEMA)}
    )
    value = lambda name: F.when(F.col("parsed"), F.col("_v")[name])
    # a number is cut to a whole one, a text must already be one
    told = F.schema_of_variant(F.try_variant_get(F.try_parse_json("_body"), "$.renovation_score", "variant"))
    odd = (told == "STRING") & ~value("renovation_score").rlike(r"^\s*[+-]?\d+\s*$")
    number = F.when(~F.coalesce(odd, F.lit(False)), X.parse_number(value("renovation_score")).try_cast("int"))
    score = F.coalesce(number, F.lit(C.VISION_SCORE_DEFAULT))
    fields = {
        "renovation_score": F.least(F.greatest(score, F.lit(low)), F.lit(high)),
        "has_outdoor_space": F.coalesce(~value("has_outdoor_space").isin("false", "0", ""), F.lit(False)),
        "reasoning": F.coalesce(value("reasoning"), F.lit("")),
    }
    for name, (accepted, default) in C.VISION_ENUMS.items():
        fields[name] = F.when(value(name).isin(accepted), value(name)).otherwise(default)
    return parsed.withColumns(fields).drop("_body", "_v")


def vision_by_listing(answers: DataFrame, listing: str = "listing_id", index: str = "photo_index") -> DataFrame:
    """Average score of a listing's photos, the first photo's other fields, photo count."""
    others = ["space_category", "luminosite", "hauteur_plafond", "has_outdoor_space", "qualite_generale"]
    first = [F.min_by(c, index).alias(c) for c in others]
    return normalise_vision(answers).groupBy(listing).agg(
        F.rint(F.avg("renovation_score")).cast("int").alias("renovation_score"),
        *first,
        F.count(F.lit(1)).alias("photos_analyzed"),
    )


def top_up(found: DataFrame, reserve: DataFrame, total: int = 8, enough: int = 4, order: str = "position") -> DataFrame:
    """Found rows, completed from a reserve list up to ``total`` when fewer than ``enough``.

    The reserve is a short fixed list, so the completion is a limit on at most
    ``total`` of its rows.
    """
    n = found.agg(F.count(F.lit(1))).scalar()
    cols = [c for c in found.columns if c != order]
    extra = reserve.orderBy(order).limit(total).withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order)))
    extra = extra.where((n < enough) & (F.col("_r") <= total - n))
    return found.select(*cols).unionByName(extra.select(*cols), allowMissingColumns=True)
