"""Column expressions over text and numbers: parsers, formats, colours, zoom levels, statuses. NULL in gives NULL out
unless said; nothing raises on odd input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the northern and southern zones, first identifiers of their coordinate systems.
NORTH, SOUTH = "NPQRSTUVWX", "CDEFGHJKLM"
NORTH_BASE, SOUTH_BASE = 32600, 32700
#: Statuses of tasks and tiles, and labels shown for them.
TASK_STATUSES = ("draft", "pending", "submitted", "running", "completed", "failed", "failed_to_submit")
TILE_STATUSES = ("draft", "started", "completed", "failed")
LABELS = {
    "draft": "Not Submitted",
    "failed_to_submit": "Submission Failed",
    "pending": "Pending",
    "submitted": "Submitted",
    "in_progress": "In Progress",
    "running": "Running",
    "completed": "Completed",
    "failed": "Failed",
}
#: Mode -> seconds of a solve, gap at which it stops.
BUDGETS = {"interactive": (1800, 0.15), "balanced": (7200, 0.05), "exact_audit": (86400, 0.0)}


def utm(text: Column) -> Column:
    """struct(zone, letter, easting, northing, srid) of `zone[letter] easting northing`; NULL if it doesn't parse or is out of range."""
    part = lambda k: F.regexp_extract(text, r"(?i)^([1-9]\d?)([C-HJ-NP-X]?) (\d+) (\d+)$", k)
    zone, letter = F.try_to_number(part(1), F.lit("99")).cast("int"), F.upper(part(2))
    easting, northing = part(3).try_cast("double"), part(4).try_cast("double")
    north = (letter == "") | F.lit(NORTH).contains(letter)
    ok = zone.between(1, 60) & easting.between(166640, 833360) & F.when(north, northing <= 9334080).otherwise(northing.between(1110400, 10000000))
    srid = F.when(north, F.lit(NORTH_BASE)).otherwise(F.lit(SOUTH_BASE)) + zone
    return F.when(ok, F.struct(zone.alias("zone"), F.nullif(letter, F.lit("")).alias("letter"), easting.alias("easting"), northing.alias("northing"), srid.alias("srid")))


def lat_long(text: Column) -> Column:
    """struct(lat, long) of two numbers with a blank between them; NULL if it doesn't parse or is out of range."""
    ok = F.rlike(text, F.lit(r"^[+-]?(\d*[.])?\d+ [+-]?(\d*[.])?\d+$"))
    lat, long = (F.split_part(text, F.lit(" "), F.lit(k)).try_cast("double") for k in (1, 2))
    return F.when(ok & lat.between(-90, 90) & long.between(-180, 180), F.struct(lat.alias("lat"), long.alias("long")))


def seed_colour(seed: Column) -> Column:
    """A colour that depends on the seed alone: a 32-bit hash of its characters, each channel brought into a range."""
    wrap = lambda x: F.pmod(x + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    code = lambda c: F.ascii(c).cast("long")
    high, low_part = lambda c: 0xD800 + F.shiftright(code(c) - 0x10000, 10), lambda c: 0xDC00 + (code(c) - 0x10000) % 0x400
    # characters beyond the first 65,536 count as the two units that they are in UTF-16
    add = lambda a, c: F.when(code(c) < 0x10000, wrap(a * 31 + code(c))).otherwise(wrap(wrap(a * 31 + high(c)) * 31 + low_part(c)))
    h = F.aggregate(F.filter(F.split(seed, ""), lambda c: c != ""), F.lit(0).cast("long"), add)
    channel = lambda shift, low, high: F.lpad(F.lower(F.hex(low + F.pmod(F.shiftright(h, shift), F.lit(256)) % (high - low + 1))), 2, "0")
    return F.concat(F.lit("#"), channel(0, 90, 190), channel(8, 90, 190), channel(16, 110, 210))


def phone(text: Column) -> Column:
    """+1 (area) exchange-subscriber of what has up to ten digits behind an optional 1; else the digits."""
    digits = F.regexp_replace(text, r"\D", "")
    home = digits.startswith("1")
    local = F.when(home, F.substring(digits, F.lit(2), F.length(digits))).otherwise(digits)
    rest = F.concat_ws("-", F.nullif(F.substring(local, 4, 3), F.lit("")), F.nullif(F.substring(local, F.lit(7), F.length(local)), F.lit("")))
    pretty = F.trim(F.concat(F.when(home, "+1").otherwise(""), F.lit(" ("), F.substring(local, 1, 3), F.lit(") "), rest))
    return F.when((F.length(digits) <= 1) | (F.length(local) > 10), digits).otherwise(pretty)


def budget(text: Column) -> Column:
    """Digits in thousands, and two decimals (cut, not rounded) if there is a point; empty without a digit or point."""
    clean = F.regexp_replace(text, r"[^0-9.]", "")
    parts = F.split(clean, r"\.")
    whole = F.format_number(F.coalesce(F.nullif(parts[0], F.lit("")).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")), 0)
    return F.when(clean == "", "").otherwise(F.concat(whole, F.when(F.size(parts) > 1, F.concat(F.lit("."), F.substring(F.get(parts, F.lit(1)), 1, 2))).otherwise("")))


def hex_colour(text: Column) -> Column:
    """# and the upper-case digits; NULL for blank text."""
    trimmed = F.trim(text)
    return F.when(trimmed != "", F.concat(F.lit("#"), F.upper(F.when(trimmed.startswith("#"), F.substring(trimmed, F.lit(2), F.length(trimmed))).otherwise(trimmed))))


def status(text: Column, allowed: tuple[str, ...] = TASK_STATUSES) -> Column:
    """The status in lower case, NULL if there is none of that name."""
    return F.when(F.lower(text).isin(*allowed), F.lower(text))


def status_label(text: Column) -> Column:
    """What is shown for a status; one without a label shows itself."""
    labels = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(labels, text), text)


def tile_url(uri: Column, host: str) -> Column:
    """pmtiles:// URL of a stored URI: as it is, of http(s), or of an object's key below host; NULL of others and of no key."""
    key = F.regexp_extract(uri, r"^s3://[^/]*/(.+)$", 1)
    return F.when(uri.startswith("pmtiles://"), uri).when(uri.startswith("http://") | uri.startswith("https://"), F.concat(F.lit("pmtiles://"), uri)).when(key != "", F.concat(F.lit(f"pmtiles://{host}/"), key))


def array_path(raw: Column, bucket: str = "") -> Column:
    """Path of an array without quotes, scheme, bucket and outer slashes."""
    text = F.regexp_replace(F.trim(raw), r"^\"(.*)\"$|^'(.*)'$", "$1$2")
    of_store = F.regexp_extract(text, r"^s3://[^/]*/?(.*)$", 1)
    of_web = F.regexp_replace(F.regexp_extract(text, r"(?i)^https?://[^/?#]*([^?#]*)", 1), "/+", "/")
    of_web = F.regexp_replace(of_web, f"^/{bucket}(/|$)", "") if bucket else of_web
    path = F.when(text.startswith("s3://"), of_store).when(F.rlike(text, F.lit("(?i)^https?://")), of_web).otherwise(text)
    return F.regexp_replace(path, "^/+|/+$", "")


def integer_setting(text: Column) -> Column:
    """A whole number, also in decimal or scientific notation; NULL for fractions, what is no number, and beyond 64 bits.

    Judged by its digits, so that no fraction is too small to be seen.
    """
    pattern = r"^([+-]?)(\d*)\.?(\d*)(?:[eE]([+-]?\d{1,9}))?$"
    plain = F.trim(text)
    part = lambda k: F.regexp_extract(plain, pattern, k)
    digits = F.concat(part(2), part(3))
    shift = F.coalesce(F.nullif(part(4), F.lit("")).try_cast("int"), F.lit(0)) - F.length(part(3))  # places that the point moves right
    whole = F.substring(digits, F.lit(1), F.greatest(F.length(digits) + shift, F.lit(0)))
    rest = F.substring(digits, F.greatest(F.length(digits) + shift, F.lit(0)) + 1, F.length(digits))
    number = F.when(F.rlike(digits, F.lit("^0+$")), F.lit("0")).when(shift > 40, F.lit(None)).when(shift >= 0, F.rpad(digits, F.length(digits) + shift, F.lit("0"))).when(F.rlike(rest, F.lit("^0*$")), F.concat(F.lit("0"), whole))
    return F.when(F.rlike(plain, F.lit(pattern)) & (digits != ""), F.concat(part(1), number).try_cast("decimal(38,0)")).try_cast("long")


def max_zoom(resolution: Column) -> Column:
    """Zoom level of a cell size in metres: 13 at 30 m and below, 7 at 5,000 m and above, by the logarithm between; half to even."""
    r = F.least(F.greatest(resolution.cast("double"), F.lit(30.0)), F.lit(5000.0))
    share = (F.log(r) - F.log(F.lit(30.0))) / (F.log(F.lit(5000.0)) - F.log(F.lit(30.0)))
    return F.when(resolution.isNotNull(), F.rint(13 - share * 6).cast("int"))


def tile_xy(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the web map tile that holds a point; points beyond the map's edge count to the last tile."""
    n = 1 << zoom
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2 * n)
    inside = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("long")
    return inside(x), inside(y)


def metatile(x: Column, y: Column, size: int = 3) -> tuple[Column, Column]:
    """The block of size x size tiles that owns a tile: half-open, so each tile has one owner."""
    return F.floor(x / size).cast("long"), F.floor(y / size).cast("long")


def runtime_mapping(native: Column, target: Column, source_row: Column, source_col: Column, same_crs: Column, policy: Column, tolerance: float = 1e-7) -> Column:
    """How a layer gets onto the grid once it runs: bounded_reproject, direct, nested_aggregate, coarse_to_fine_... or prohibited.

    Alignment comes first here, so a coarser layer that isn't aligned is judged by its policy only after that.
    """
    factor = F.abs(target / native)
    near = lambda a, b: F.abs(a - b) <= tolerance
    aligned = near(source_row, F.rint(source_row)) & near(source_col, F.rint(source_col)) & near(factor, F.greatest(F.lit(1.0), F.rint(factor)))
    one = F.greatest(F.lit(1.0), F.rint(factor)) == 1
    coarse = F.when(policy.isin("nearest_constant", "overlap_constant"), F.concat(F.lit("coarse_to_fine_"), policy)).otherwise("prohibited")
    return F.when(~same_crs, "bounded_reproject").when(aligned & one, "direct").when(aligned & (native < F.abs(target)), "nested_aggregate").when(native > F.abs(target), coarse).otherwise("bounded_reproject")


def legacy_hash(key: Column) -> Column:
    """64 hex digits for rows from before there were content hashes: two MD5 of the key with a mark behind it."""
    return F.concat(F.md5(F.concat(key.cast("string"), F.lit(":legacy"))), F.md5(F.concat(key.cast("string"), F.lit(":legacy:2"))))


def blank_to_null(text: Column, kind: str) -> Column:
    """An empty setting is none; what doesn't cast is none either."""
    return F.nullif(text, F.lit("")).try_cast(kind)


def with_entry(json: Column, path: str | Sequence[str], value: Column) -> Column:
    """A JSON object with one entry set, whether it was there or not; NULL counts as an empty object.

    path: a key, or keys of objects within each other; where one before the last is missing or no object, nothing is set.
    All other entries, and value, keep their types: value may be text, a number, a boolean, a variant or NULL.
    """
    first, *rest = [path] if isinstance(path, str) else path
    kind = "map<string,variant>"
    entries = F.coalesce(F.from_json(json, kind), F.create_map().cast(kind))
    if not rest:
        return F.to_json(F.map_concat(F.map_filter(entries, lambda k, _: k != first), F.create_map(F.lit(first), F.coalesce(value.cast("variant"), F.parse_json(F.lit("null"))))))
    inner = F.to_json(F.try_element_at(entries, F.lit(first)))
    changed = F.map_concat(F.map_filter(entries, lambda k, _: k != first), F.create_map(F.lit(first), F.try_parse_json(with_entry(inner, rest, value))))
    return F.to_json(F.when(F.coalesce(inner.startswith("{"), F.lit(False)), changed).otherwise(entries))


def part_size(size: Column, least: int = 5 << 20, parts: int = 10_000) -> Column:
    """Bytes of a part of an upload: as few parts as fit, but none below the least size."""
    return F.greatest(F.lit(least), F.ceil(size / parts)).cast("long")


def mode_budget(mode: Column) -> tuple[Column, Column]:
    """Seconds and gap of a mode; NULL for one that isn't known."""
    pick = lambda k: F.try_element_at(F.create_map(*(F.lit(x) for m, b in BUDGETS.items() for x in (m, b[k]))), mode)
    return pick(0), pick(1)


def group_matches(name: Column, group: Column, search: str, groups: tuple[str, ...]) -> Column:
    """Whether a layer's name holds the search text and, if groups are asked for, one is a segment of its group path."""
    text = search.strip().lower()
    hit = F.lit(True) if not text else F.lower(name).contains(text)
    return hit & F.arrays_overlap(F.split(F.lower(group), "/"), F.array(*map(F.lit, groups))) if groups else hit


def segments_with(group: Column, prefix: str) -> Column:
    """Segments of a group path that begin with the prefix."""
    return F.filter(F.split(F.lower(group), "/"), lambda s: s.startswith(prefix.strip().lower()))


def emails(texts: Column) -> Column:
    """Addresses trimmed, in lower case, each once in the order of their first use, without blank ones."""
    return F.array_distinct(F.filter(F.transform(texts, lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != "")))


def used_layers(objectives: Column, constraints: Column) -> Column:
    """Layers of objectives, then of constraints, each once."""
    return F.array_distinct(F.concat(objectives, constraints))
