"""Column helpers. All are JVM expressions; missing numbers are NULL and never NaN."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value.
MISSING = ("None", "nan", "NaN", "NULL", "null", "", " ", "-")
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Fixed value: a house number at the head of an address.
HOUSE_NUMBER = r"(?iU)^\s*\d+\s*(?:(?:bis|ter|quater|quinquies)\b|[a-z]\b)?\s*"
# Metres per degree for stations and for walks.
METRES_STATION = 111_320.0
METRES_WALK = 111_195.0
# The palettes of price levels and of yearly change, and the grey of scarce data.
PRICE_PALETTE = (
    "#00695c", "#2f9a83", "#6fbd9f", "#a8dcbe", "#cfe9ad", "#e6f3ab", "#f9f7a0", "#ffe988",
    "#ffd96b", "#fdc453", "#fbab48", "#f7913f", "#f2763a", "#e55334", "#d02c28", "#a50026",
)
TREND_PALETTE = (
    "#67001f", "#b2182b", "#d6604d", "#f4a582", "#fddbc7", "#ffffff", "#d9f0d3", "#a6dba0",
    "#5aae61", "#1b7837", "#00441b",
)
GREY = "#d9d9d9"


def text_or_null(x: Column) -> Column:
    """The trimmed text, NULL for a missing marker."""
    t = F.trim(x)
    return F.when(~t.isin(*MISSING), t)


def parse_number(x: Column) -> Column:
    """Plain number, else with white space dropped and a decimal comma; otherwise NULL."""
    plain = F.trim(x)
    loose = F.replace(F.regexp_replace(plain, r"(?U)\s", ""), F.lit(","), F.lit("."))
    return F.when(plain.rlike(_NUMBER), plain.try_cast("double")).when(loose.rlike(_NUMBER), loose.try_cast("double"))


def half_even(x: Column, digits: int = 0) -> Column:
    """Half-to-even rounding of the scaled double; -0.0 becomes 0.0."""
    if not digits:
        return F.rint(x) + F.lit(0.0)
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def zero_fill(x: Column, width: int = 5) -> Column:
    """Pads with zeros and never truncates."""
    return F.when(F.length(x) < width, F.lpad(x, width, "0")).otherwise(x)


def title_case(x: Column) -> Column:
    """Upper case after anything that is no letter."""
    parts = F.split(F.lower(x), r"(?<=[^\p{L}])|(?=[^\p{L}])")
    return F.array_join(F.transform(parts, F.initcap), "")


def address_key(x: Column) -> Column:
    """Folded case, single spaces: two spellings of one address have one key."""
    return F.replace(F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), F.lit("ß"), F.lit("ss"))


def street_of(address: Column) -> Column:
    return F.trim(F.regexp_replace(address, HOUSE_NUMBER, ""))


def plain_letters(x: Column) -> Column:
    """Latin letters without accents."""
    return F.translate(x, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")


def name_key(x: Column) -> Column:
    """Letters and digits only, without accents or case."""
    return F.regexp_replace(F.replace(F.lower(plain_letters(x)), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]", "")


def search_key(x: Column) -> Column:
    """`name_key` with spaces kept and `st`, `ste` spelled out."""
    words = F.trim(F.regexp_replace(F.lower(plain_letters(x)), r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(F.regexp_replace(words, r"\bst\b", "saint"), r"\bste\b", "sainte")


def department_of(commune: Column) -> Column:
    two = F.substring(commune, 1, 2)
    return F.when(two.isin("97", "98"), F.substring(commune, 1, 3)).otherwise(two)


def section_code(parcel: Column, commune: Column, prefix: Column) -> Column:
    """Ten characters of the parcel, else commune and section prefix."""
    return F.when(F.length(parcel) >= 10, F.substring(parcel, 1, 10)).otherwise(F.concat(zero_fill(commune), zero_fill(prefix)))


def short_section(section: Column) -> Column:
    return F.regexp_replace(F.substring(section, 6, 100), "^0+", "")


def date_number(d: Column) -> Column:
    """YYYYMMDD, -1 if missing."""
    return F.coalesce(F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d), F.lit(-1))


def whole_or_sentinel(x: Column) -> Column:
    return F.coalesce(F.rint(x).cast("long"), F.lit(-1).cast("long"))


def whole_and_hundredths(x: Column) -> tuple[Column, Column]:
    """Integer part and hundredths; together they give the value back exactly, or the row fails."""
    whole = F.floor(x)
    rest = F.rint((x - whole) * 100).cast("long")
    same = (whole * 100 + rest) / F.lit(100.0) == x
    return F.when(same, whole).otherwise(F.raise_error(F.lit("more than two decimals")).cast("long")), rest


def tile_x(lon: Column, zoom: int) -> Column:
    side = float(2**zoom)
    return F.when(lon.isNotNull(), F.greatest(F.least(F.floor((lon + 180.0) / 360.0 * side), F.lit(int(side) - 1)), F.lit(0)).cast("long"))


def tile_y(lat: Column, zoom: int) -> Column:
    """Web Mercator; latitudes are clipped where the projection ends."""
    side = float(2**zoom)
    phi = F.radians(F.greatest(F.least(lat, F.lit(85.05112878)), F.lit(-85.05112878)))
    y = F.floor((1.0 - F.asinh(F.tan(phi)) / F.pi()) / 2.0 * side)
    return F.when(lat.isNotNull(), F.greatest(F.least(y, F.lit(int(side) - 1)), F.lit(0)).cast("long"))


def planar_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, metres: float = METRES_STATION) -> Column:
    dx = (lon1 - lon2) * metres * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat1 - lat2) * metres
    return F.sqrt(dx * dx + dy * dy)


def walk_minutes(metres: Column) -> Column:
    return F.when(metres.isNotNull(), F.greatest(F.lit(1), F.ceil(metres / 64.0)).cast("long"))


def colour(position: Column, palette: Sequence[str]) -> Column:
    """Piecewise linear colour at a position that is clamped to [0, 1]; grey if it is missing."""
    last = len(palette) - 1
    at = F.greatest(F.least(position, F.lit(1.0)), F.lit(0.0)) * last
    low = F.floor(at).cast("int")
    high = F.least(low + 1, F.lit(last))
    part = at - low
    hexes = []
    for k in (1, 3, 5):
        channel = F.array(*(F.lit(int(c[k : k + 2], 16)) for c in palette))
        a, b = F.get(channel, low), F.get(channel, high)
        hexes.append(F.lpad(F.lower(F.hex(F.rint(a + (b - a) * part).cast("long"))), 2, "0"))
    # greatest and least skip nulls, so a missing position is told apart here
    return F.when(position.isNotNull(), F.concat(F.lit("#"), *hexes)).otherwise(F.lit(GREY))


# Fixed values of labels.
MISSING_LABEL, THOUSANDS = "n/d", " "


def euro_label(x: Column, suffix: str = " €") -> Column:
    """Whole euros, thousands set apart."""
    text = F.replace(F.format_number(F.rint(x), 0), F.lit(","), F.lit(THOUSANDS))
    return F.when(x.isNull() | F.isnan(x), MISSING_LABEL).otherwise(F.concat(text, F.lit(suffix)))


def rate_label(x: Column) -> Column:
    """A yearly rate in per cent with its sign, one decimal and a comma."""
    digits = F.replace(F.replace(F.format_number(F.abs(x), 1), F.lit(","), F.lit("")), F.lit("."), F.lit(","))
    sign = F.when(x < 0, "-").otherwise("+")
    return F.when(x.isNull() | F.isnan(x), MISSING_LABEL).otherwise(F.concat(sign, digits, F.lit(" %/an")))
