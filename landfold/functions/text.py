"""Names, search text, paths and identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landfold.functions.geometry import col

# Simplified characters and their traditional forms, pair by pair.
SIMPLIFIED = (
    "华厅联际毕业贵实现属细组览辆学湾东体诚创楼术郑务卢骢叶达贤义会议艺动黄书电变验级计红鸟乔罗馆综习爱访资讯骅赛马骝竞荟贸湿滨吴韦玮圆剧场"
    "烧园广树连桥贡宝鱿鱼银峦台径宁亚门冯凤龙狮兰关驿长岗屿岭带结环内侧处号层车间饮厕护摄灯柜墙浅绿双顶线转区锈钢标储开温撑边耸弯杆宽"
    "职员独俪医宾云轩陈满"
)
TRADITIONAL = (
    "華廳聯際畢業貴實現屬細組覽輛學灣東體誠創樓術鄭務盧驄葉達賢義會議藝動黃書電變驗級計紅鳥喬羅館綜習愛訪資訊驊賽馬騮競薈貿濕濱吳韋瑋圓劇場"
    "燒園廣樹連橋貢寶魷魚銀巒臺徑寧亞門馮鳳龍獅蘭關驛長崗嶼嶺帶結環內側處號層車間飲廁護攝燈櫃牆淺綠雙頂線轉區鏽鋼標儲開溫撐邊聳彎桿寬"
    "職員獨儷醫賓雲軒陳滿"
)
CONTENT_TYPES = {
    "html": "text/html; charset=utf-8", "js": "text/javascript", "css": "text/css", "json": "application/json",
    "glb": "model/gltf-binary", "png": "image/png", "jpg": "image/jpeg", "webp": "image/webp", "svg": "image/svg+xml",
}
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII")
HAN = "[㐀-鿿]"


def script_fold(text, locale: str = "zh-Hans") -> Column:
    """Character-wise traditional to simplified, or back for zh-Hant."""
    if locale == "zh-Hant":
        return F.translate(col(text), SIMPLIFIED, TRADITIONAL)
    return F.translate(col(text), TRADITIONAL + "寳", SIMPLIFIED + "宝")


def normalize_search(text) -> Column:
    return F.trim(F.regexp_replace(F.lower(script_fold(text)), r"\s+", " "))


def norm_alnum(text) -> Column:
    return F.regexp_replace(F.lower(col(text)), "[^a-z0-9]", "")


def display_name(name, aliases, locale: str, type=None, override=None, specific=None, message=None) -> Column:
    """Override, authored special name, numbered pattern, first alias in the script, converted name."""
    name, aliases = col(name), col(aliases)
    number = F.regexp_extract(name, r"^官方未命名道路 · STREETCODE (\d+)$", 1)
    unnamed = "Unnamed official road" if locale == "en" else "官方未命名道路"
    if locale == "en":
        fallback = F.coalesce(
            F.get(F.filter(aliases, lambda a: a.rlike("[A-Za-z]") & ~a.rlike(HAN)), F.lit(0)), *([message] if message is not None else []), name
        )
    else:
        chinese = F.when(name.rlike(HAN), name).otherwise(F.get(F.filter(aliases, lambda a: a.rlike(HAN)), F.lit(0)))
        fallback = script_fold(F.coalesce(chinese, name), locale)
    out = F.when(number != "", F.concat(F.lit(unnamed + " · STREETCODE "), number)).otherwise(fallback)
    firsts = [c for c in (override, specific) if c is not None]
    out = F.coalesce(*firsts, out) if firsts else out
    return F.when(col(type) == "floor", name).otherwise(out) if type is not None else out


def search_names(name, aliases) -> Column:
    shown = [display_name(name, aliases, loc) for loc in ("en", "zh-Hant", "zh-Hans")]
    return F.array_compact(F.concat(F.array(col(name)), col(aliases), F.array(*shown)))


def resolve_locale(value) -> Column:
    """Supported interface locales; anything else is simplified Chinese."""
    v = col(value)
    return F.when(v.isin("en", "zh-Hant", "zh-Hans"), v).otherwise("zh-Hans")


def fill_message(template, params) -> Column:
    """Replace each {name} by its parameter."""
    return F.aggregate(
        F.map_entries(col(params)), col(template),
        lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]),
    )


def safe_path(path) -> Column:
    p = col(path)
    return ~(
        (p == "") | p.startswith("/") | p.contains("\\") | F.arrays_overlap(F.split(p, "/"), F.array(F.lit(".."), F.lit("."), F.lit("")))
    )


def valid_sha256(value) -> Column:
    return col(value).rlike("^[a-f0-9]{64}$")


def content_type(path) -> Column:
    kinds = F.create_map(*[F.lit(v) for pair in CONTENT_TYPES.items() for v in pair])
    suffix = F.lower(F.regexp_extract(col(path), r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(kinds, suffix), F.lit("application/octet-stream"))


def roman_to_number(text) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(r) for r in ROMAN]), F.upper(col(text))), F.lit(0))


def number_to_roman(n) -> Column:
    return F.get(F.array(*[F.lit(r) for r in ROMAN]), col(n).cast("int") - 1)


def owner_id(entity_id, building_id) -> tuple[Column, Column]:
    """Owner and error: an explicit id must be type:token and agree with a legacy building id."""
    e, b = col(entity_id), col(building_id)
    legacy = F.concat(F.lit("building:"), b)
    error = (
        F.when(e.isNull() & b.isNull(), "missing-owner")
        .when(e.isNotNull() & ~e.rlike("^(building|zone):[A-Za-z0-9][A-Za-z0-9:_-]*$"), "invalid-entity-id")
        .when(e.startswith("building:") & (legacy != e), "owner-mismatch")
    )
    return F.when(error.isNull(), F.coalesce(e, legacy)), error


def decode_id_position(object_id, origin_e: float, origin_n: float) -> tuple[Column, Column]:
    """Grid digits inside an object id to local x and z; NULL where there are none."""
    digits = lambda i: F.nullif(F.regexp_extract(col(object_id), r"(\d{6})[_-](\d{6})", i), F.lit("")).cast("double")
    return digits(1) - origin_e, F.lit(origin_n) - digits(2)
