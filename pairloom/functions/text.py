"""Normal forms and extracts of strings, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Street words and their short forms, in the order they are written out.
STREET_WORDS = (
    ("st", "street"), ("ave", "avenue"), ("dr", "drive"), ("rd", "road"), ("blvd", "boulevard"), ("ln", "lane"),
    ("ct", "court"), ("pl", "place"), ("sq", "square"), ("pkwy", "parkway"), ("cir", "circle"), ("hwy", "highway"),
)

#: The patterns of a URL, a phone and a street in page text.
URL = r"https?://[^\s\]\"'}>,]+"
PHONE = r"(?:\+?1?[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}(?![\p{L}\p{N}_])"
STREET = r"(?iU)\d+\s+[\w\s]+(?:street|st|avenue|ave|blvd|road|rd|drive|dr|lane|ln|court|ct)\b[\w\s,]*"

#: Marks of a country in upper-case address text, in the order they are tried.
REGIONS = {
    "US": (" UNITED STATES", " USA", " U.S."), "CA": (" CANADA", " CAN", " ON ", " BC ", " AB ", " QB "),
    "GB": (" UNITED KINGDOM", " UK", " GB ", " ENGLAND", " SCOTLAND"),
}

#: Postal abbreviations of the United States.
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split()


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def expand_street_words(c: Column) -> Column:
    """Lower case with whole short street words written out; NULL becomes empty."""
    lower = F.coalesce(F.lower(c), F.lit(""))
    return reduce(lambda x, w: F.regexp_replace(x, rf"(?U)\b{w[0]}\b", w[1]), STREET_WORDS, lower)


def phone_digits(c: Column) -> Column:
    """The digits of a phone column, of arrays those of all numbers in a row; NULL becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\D", "")


def website(c: Column) -> Column:
    """Lower case without scheme, www. and slashes at the ends; arrays are left as they are but for case."""
    lower = stripped(F.lower(F.coalesce(c, F.lit(""))))
    bare = F.regexp_replace(F.regexp_replace(lower, "^https?://", ""), r"^www\.", "")
    return F.regexp_replace(bare, "^/+|/+$", "")


def _kind(c: Column) -> Column:
    """object, array, other for JSON text; NULL for anything that is none."""
    parsed = F.schema_of_variant(F.try_parse_json(c))
    return F.when(parsed.isNull(), None).when(parsed.startswith("OBJECT"), "object").when(parsed.startswith("ARRAY"), "array").otherwise("other")


def address_text(c: Column, fields: tuple[str, ...] = ("freeform", "locality", "region", "postcode", "country")) -> Column:
    """The parts of the first address joined by commas, street words written out.

    JSON that is no object, an empty array among it, and plain text are taken as they stand; NULL becomes empty.
    """
    def part(prefix: str) -> Column:
        cells = [F.trim(F.coalesce(F.get_json_object(c, f"{prefix}.{f}"), F.lit(""))) for f in fields]
        return F.array_join(F.filter(F.array(*cells), lambda x: x != ""), ", ")

    kind = _kind(c)
    first_is_object = F.get_json_object(c, "$[0]").startswith("{")
    text = F.when(kind == "object", part("$")).when((kind == "array") & first_is_object, part("$[0]")).otherwise(c)
    return expand_street_words(text)


def address_freeform(c: Column) -> Column:
    """As ``address_text`` with the freeform part alone."""
    return address_text(c, ("freeform",))


def primary(c: Column, key: str = "primary") -> Column:
    """The named member of a JSON object; empty for a missing one and for anything that is no object."""
    return F.when(_kind(c) == "object", F.coalesce(F.get_json_object(c, f"$.{key}"), F.lit(""))).otherwise("")


def primary_is_null(c: Column) -> Column:
    """Whether the object has the member ``primary`` and it is null, which older results count as filled."""
    return F.coalesce(F.is_variant_null(F.try_variant_get(F.try_parse_json(c), "$.primary", "variant")), F.lit(False))


def freeform_address(c: Column) -> Column:
    """freeform of the first address or of the object."""
    return F.coalesce(F.get_json_object(c, "$[0].freeform"), F.get_json_object(c, "$.freeform"), F.lit(""))


def first_item(c: Column) -> Column:
    """First element of a JSON array, or the text of a JSON string; empty for anything else."""
    text = F.get_json_object(F.concat(F.lit("["), c, F.lit("]")), "$[0]")
    return F.coalesce(F.when(_kind(c) == "array", F.get_json_object(c, "$[0]")).when(stripped(c).startswith('"'), text), F.lit(""))


def first_url(c: Column) -> Column:
    """First element of an array written as JSON, else the text itself."""
    text = stripped(F.coalesce(c, F.lit("")))
    return F.when(text.startswith("["), F.coalesce(F.nullif(stripped(F.get_json_object(text, "$[0]")), F.lit("null")), text)).otherwise(text)


def primary_lower(c: Column) -> Column:
    """Lower-case primary of an object, or the lower-case text where it is none."""
    text = stripped(F.coalesce(c, F.lit("")))
    return F.when(text.startswith("{") & F.try_parse_json(text).isNotNull(), stripped(F.lower(primary(text)))).otherwise(F.lower(text))


def display(c: Column) -> Column:
    """Text for display; what is empty reads (empty)."""
    return F.coalesce(F.nullif(stripped(c), F.lit("")), F.lit("(empty)"))


def sources_info(c: Column) -> Column:
    """Number of entries, latest time and distinct lower-case datasets of an array of sources."""
    entries = F.from_json(c, "array<struct<dataset:string,update_time:string>>")
    listed = F.when(_kind(c) == "array", entries)
    times = F.transform(listed, lambda e: F.try_to_timestamp(e["update_time"]))
    return F.struct(
        F.coalesce(F.json_array_length(F.when(_kind(c) == "array", c)), F.lit(0)).alias("n"), F.array_max(times).alias("latest"),
        F.coalesce(F.array_sort(F.array_distinct(F.array_compact(F.transform(listed, lambda e: F.lower(e["dataset"]))))), F.array().cast("array<string>")).alias("datasets"),
    )


def locality_and_postcode(c: Column) -> Column:
    """Lower-case locality and postcode of the first address."""
    def cell(name: str) -> Column:
        return F.lower(F.trim(F.coalesce(F.get_json_object(c, f"$[0].{name}"), F.get_json_object(c, f"$.{name}"), F.lit(""))))

    return F.struct(cell("locality").alias("locality"), cell("postcode").alias("postcode"))


def has_content(c: Column, strict: bool = False) -> Column:
    """Whether a column says something; the strict form also refuses written empties such as [] and null."""
    text = c.cast("string")
    if strict:
        return F.coalesce(~F.lower(F.trim(text)).isin("", "nan", "none", "{}", "[]", "null"), F.lit(False))
    return F.coalesce(F.length(text) > 0, F.lit(False))


def extract_url(c: Column) -> Column:
    """The first URL in wrapped text, else the text without its wrapping."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\[\]\"'{}]+|[\s\[\]\"'{}]+$", "")
    found = F.regexp_replace(F.regexp_extract(bare, URL, 0), r"[.,;:)]+$", "")
    return F.when(found != "", found).otherwise(bare)


def with_scheme(c: Column, scheme: str = "https://") -> Column:
    """A URL that has a scheme; empty stays empty."""
    text = stripped(F.coalesce(c, F.lit("")))
    return F.when((text == "") | F.regexp_like(text, F.lit("^https?://")), text).otherwise(F.concat(F.lit(scheme), text))


def significant_words(c: Column) -> Column:
    """Words of more than two letters."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}_\s\x85\p{Z}]", " "), r"(?U)\s+"), lambda w: F.length(w) > 2)


def page_has_name(page: Column, name: Column) -> Column:
    """Whether any significant word of the name is in the page; a name without one always is."""
    words = significant_words(name)
    return (F.size(words) == 0) | F.exists(words, lambda w: F.contains(F.lower(page), F.lower(w)))


def html_text(c: Column) -> Column:
    """Text of HTML: scripts and styles dropped, tags made spaces, common entities read."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return stripped(F.regexp_replace(bare, r"(?U)\s+", " "))


def first_phone(c: Column) -> Column:
    """First number of the North American shape, a country prefix with it; empty without one."""
    return stripped(F.coalesce(F.regexp_extract(c, PHONE, 0), F.lit("")))


def first_street(c: Column) -> Column:
    """First house number with words up to a street word; empty without one."""
    return stripped(F.coalesce(F.regexp_extract(c, STREET, 0), F.lit("")))


def json_ld(c: Column) -> Column:
    """The first JSON-LD block of a page."""
    return F.regexp_extract(c, r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1)


def page_category(c: Column) -> Column:
    """@type of the first JSON-LD block unless it is the page or the organisation."""
    kind = F.get_json_object(json_ld(c), "$['@type']")
    return F.when(kind.isin("WebPage", "Organization") | kind.isNull(), "").otherwise(kind)


def page_address(c: Column) -> Column:
    """An address of a page: JSON-LD, else the first line that reads like one."""
    block = json_ld(c)
    parts = [F.get_json_object(block, f"$.address.{k}") for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode")]
    told = F.concat_ws(", ", *parts)
    return F.when(told != "", told).otherwise(first_street(html_text(c)))


def canonical_url(page: Column, url: Column) -> Column:
    """The canonical link of a page, else its own URL; bare and lower case."""
    link = F.regexp_extract(page, r'(?is)<link[^>]*rel=["\']canonical["\'][^>]*href=["\']([^"\']+)', 1)
    return F.regexp_replace(F.regexp_replace(F.lower(F.when(link != "", link).otherwise(url)), "^https?://", ""), "^/+|/+$", "")


def address_parts(c: Column) -> Column:
    """Leading number, unit and street of an address."""
    text = F.coalesce(c, F.lit(""))
    number = F.regexp_extract(text, r"^(\d+)\s+(.*)", 1)
    rest = F.when(number != "", F.regexp_extract(text, r"^(\d+)\s+(.*)", 2)).otherwise(text)
    unit = r"\b(ste|suite|apt|unit|#)\s*([\w-]+)"
    told = F.regexp_extract(rest, unit, 0) != ""
    street = F.when(told, F.trim(F.regexp_replace(rest, unit, ""))).otherwise(rest)
    return F.struct(number.alias("num"), street.alias("street"), F.when(told, F.concat_ws(" ", F.regexp_extract(rest, unit, 1), F.regexp_extract(rest, unit, 2))).otherwise("").alias("unit"))


def region_of(c: Column) -> Column:
    """Country a phone would be read in, told from the address text."""
    text = F.upper(F.coalesce(c, F.lit("")))
    out = F.lit(None).cast("string")
    for region, forms in reversed(REGIONS.items()):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(f)) for f in forms]), region).otherwise(out)
    return F.coalesce(out, F.when(F.regexp_like(text, F.lit(r"(?U)\b(?:" + "|".join(STATES) + r")\b")), "US"))


def phone_e164(c: Column, region: Column | None = None) -> Column:
    """International form of a number by its shape; NULL if it has none. Only lengths and prefixes are checked."""
    text = stripped(F.coalesce(c, F.lit("")))
    digits = F.regexp_replace(text, r"\D", "")
    plus = F.when(text.startswith("+") & F.regexp_like(digits, F.lit(r"^[1-9]\d{7,14}$")), F.concat(F.lit("+"), digits))
    if region is None:
        return plus
    code = F.when(region.isin("US", "CA"), "1").when(region == "GB", "44").when(region == "DE", "49").when(region == "FR", "33").when(region == "ES", "34").when(region == "BR", "55")
    national = F.when(region.isin("US", "CA"), F.regexp_extract(digits, r"^1?([2-9]\d{2}[2-9]\d{6})$", 1)).otherwise(F.regexp_extract(digits, r"^0?([1-9]\d{6,11})$", 1))
    return F.coalesce(plus, F.when((national != "") & code.isNotNull(), F.concat(F.lit("+"), code, national)))


def phone_is_valid(c: Column, region: Column | None = None) -> Column:
    return phone_e164(c, region).isNotNull()


def address_score(c: Column) -> Column:
    """0 to 3: digits, a street word, a state or postcode; 0 for very short text."""
    text = F.coalesce(c, F.lit(""))
    marks = [r"\d", r"(?i)\b(?:st|street|ave|avenu|road|rd|blvd|dr)\b", r"\b[A-Z]{2}\b|\b\d{5}(?:-\d{4})?\b"]
    return F.when(F.length(F.trim(text)) < 5, 0).otherwise(reduce(lambda a, b: a + b, [F.regexp_like(text, F.lit(m)).cast("int") for m in marks]))


def address_completeness(c: Column) -> Column:
    """Number of filled parts over all addresses of a column."""
    listed = F.from_json(F.when(_kind(c) == "object", F.concat(F.lit("["), c, F.lit("]"))).otherwise(c), "array<map<string,string>>")
    counts = F.transform(listed, lambda m: F.size(F.filter(F.map_values(m), lambda v: F.trim(v) != "")))
    return F.coalesce(F.aggregate(counts, F.lit(0), lambda a, b: a + b), F.lit(0))


def cache_key(*parts: Column) -> Column:
    """Key of a memo: md5 of the parts joined by colons."""
    return F.md5(F.concat_ws(":", *parts))


def model_answer(c: Column) -> Column:
    """Winners, label and reason of a model's answer; text around the object is passed over."""
    whole = F.when(F.try_parse_json(c).isNotNull(), c)
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    text = F.coalesce(whole, F.when(F.try_parse_json(inner).isNotNull(), inner))

    def pick(key: str, allowed: tuple[str, ...], other: str) -> Column:
        value = F.lower(F.trim(F.get_json_object(text, f"$.{key}")))
        return F.when(value.isin(*allowed), value).otherwise(other)

    cells = [pick(a, ("base", "alt", "both", "none"), "none").alias(f"attr_{a}_winner") for a in ("name", "phone", "web", "address", "category")]
    return F.struct(*cells, pick("golden_label", ("base", "alt"), "abstain").alias("golden_label"), F.coalesce(F.get_json_object(text, "$.reason"), F.lit("")).alias("slm_reason"))


def answer_json(winners: dict[str, Column]) -> Column:
    """The answer a model is trained to give: the winners as JSON."""
    return F.to_json(F.struct(*[c.alias(a) for a, c in winners.items()]))


def prompt(fields: dict[str, tuple[Column, Column]]) -> Column:
    """A prompt that shows both sides of each field."""
    lines = [F.concat(F.lit(f"{name}: base="), display(b), F.lit(" | alt="), display(a)) for name, (b, a) in fields.items()]
    head = F.lit("Decide for each attribute whether base, alt, both or none is right. Answer with one JSON object.")
    return F.concat_ws("\n", head, *lines)


def place_details(c: Column) -> Column:
    """Phone, website, address and category of a places API payload."""
    phone = F.coalesce(F.get_json_object(c, "$.internationalPhoneNumber"), F.get_json_object(c, "$.nationalPhoneNumber"), F.lit(""))
    return F.struct(
        phone.alias("phone"), F.coalesce(F.get_json_object(c, "$.websiteUri"), F.lit("")).alias("web"),
        F.coalesce(F.get_json_object(c, "$.formattedAddress"), F.lit("")).alias("address"), F.coalesce(F.get_json_object(c, "$.types[0]"), F.lit("")).alias("category"),
    )
