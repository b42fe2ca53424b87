"""Column functions: text keys, numbers, bands, lists and share maps. Null in, null out unless stated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Typographic marks and what they fold to; tokens that stand for missing; words that stand for true.
TYPOGRAPHIC, PLAIN = "‘’“”–—", "''\"\"--"
MISSING = ("", "nan", "none", "null", "na", "n/a")
TRUE, FALSE = ("true", "1", "yes", "y", "t"), ("false", "0", "no", "n", "f")


#: Words that begin the extent of a place, and words that belong to names in any case.
EXTENT_MARKERS = ("CD Block", "CD Blocks", "C.D. Block", "C.D. Blocks", "Mandal", "Mandals", "Gram Panchayat", "Gram Panchayats", "Ward", "Wards", "DMC", "Tehsil", "Tehsils", "Taluk", "Taluks", "Block", "Blocks", "Nagar Parishad", "Nagar Palika", "Nagar", "Including", "Comprising", "Revenue", "Circle", "Town", "Village", "Area", "Entire", "Part of", "P.S.", "M.C.", "M.P.", "District", "Assembly Constituency")
NAME_WORDS = ("AND", "CUM", "PUR", "NAGAR", "RURAL", "URBAN", "NORTH", "SOUTH", "EAST", "WEST", "CITY", "CANTONMENT", "SADAR")


def squash_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def to_number(c: Column) -> Column:
    """Number without thousands commas; null if it is none."""
    return F.regexp_replace(c, ",", "").try_cast("double")


def contest_id(region: Column, contest: Column) -> Column:
    part = lambda x: F.replace(F.upper(F.trim(x)), F.lit(" "), F.lit("_"))
    return F.concat(part(region), F.lit("__"), part(contest))


def slug(c: Column, keep: str = "") -> Column:
    """Upper case, typographic marks folded, other runs to `_`, none at the ends. keep: characters to leave."""
    folded = F.upper(F.translate(c, TYPOGRAPHIC, PLAIN))
    inside = "".join("\\" + x for x in keep)
    return F.regexp_replace(F.regexp_replace(folded, f"[^A-Z0-9{inside}]+", "_"), "^_+|_+$", "")


def from_map(c: Column, pairs: Mapping[str, str]) -> Column:
    """The mapped value; null without one."""
    entries = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), c) if entries else F.lit(None).cast("string")


def normalise_party(c: Column, aliases: Mapping[str, str]) -> Column:
    """Upper-cased and squashed: its alias, else a short token (at most 15 characters, no blank) as it is, else PARTY_ and 40
    characters of the slug."""
    c = squash_ws(F.upper(c))
    short = (F.char_length(c) <= 15) & ~c.contains(" ")
    return F.coalesce(from_map(c, aliases), F.when(short, c).otherwise(F.concat(F.lit("PARTY_"), F.substring(slug(c), 1, 40))))


def candidate_id(period: Column, region: Column, contest: Column, party: Column, name: Column) -> Column:
    return F.concat_ws("_", F.lit("CAND"), period.cast("string"), slug(region), slug(contest), slug(party), slug(name))


def norm_key(c: Column, ampersand: bool = True, reservation: bool = True, dash: bool = True, punctuation: bool = False) -> Column:
    """Upper-case key: `&` to AND, dashes and slashes to blanks, (SC), (ST), (GEN) dropped, other signs to blanks on request,
    white space squashed."""
    out = F.upper(c)
    if ampersand:
        out = F.regexp_replace(out, "&", " AND ")
    if reservation:
        out = F.regexp_replace(out, r"\((SC|ST|GEN)\)", " ")
    if dash:
        out = F.regexp_replace(out, r"[-/–—]", " ")
    if punctuation:
        out = F.regexp_replace(out, r"[^A-Z0-9]+", " ")
    return squash_ws(out)


def region_key(c: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Upper-case region with ` AND ` as ` & `, then through aliases."""
    out = F.regexp_replace(squash_ws(F.upper(c)), " AND ", " & ")
    return F.coalesce(from_map(out, aliases), out) if aliases else out


def contest_key(c: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Upper-case contest without reservation mark and with other signs as blanks, then through aliases."""
    out = squash_ws(F.regexp_replace(F.regexp_replace(F.upper(c), r"\((SC|ST|GEN)\)", " "), r"[^A-Z0-9]+", " "))
    return F.coalesce(from_map(out, aliases), out) if aliases else out


def strip_reference_suffix(c: Column) -> Column:
    """Cut `(...)`, `, 12-...` and ` 12-...` from the end of a name."""
    for pattern in (r"\s*\(.*\)\s*$", r",\s*\d+\s*-.*$", r"\s+\d+\s*-.*$"):
        c = F.regexp_replace(c, pattern, "")
    return F.trim(c)


def short_name(c: Column, markers: Sequence[str] = ("PART", "EXCLUDING", "INCLUDING"), words: int = 6, most: int = 60) -> Column:
    """Text before a marker word and the first comma, its leading capitalised words (at most `words`), `most` characters."""
    cut = F.regexp_replace(c, rf"(?i)\b({'|'.join(markers)})\b.*$", "")
    first = F.substring(F.trim(F.get(F.split(cut, ","), F.lit(0))), 1, most)
    return F.trim(F.regexp_extract(first, rf"^((?:[A-Z][\w.'-]*\s*){{1,{words}}})", 1))


def extent_name(c: Column, markers: Sequence[str] = EXTENT_MARKERS, keepers: Sequence[str] = NAME_WORDS, words: int = 6, most: int = 60) -> Column:
    """The name that stands before its extent: without reservation mark, cut at a marker word and, if what is before it is at most
    `most` long, at the first comma; then its first word and the capitalised or keeper words after it, at most `words` in all."""
    text = squash_ws(F.regexp_replace(c, r"(?i)\((SC|ST|GEN)\)", " "))
    marked = "|".join(m.replace(".", r"\.") for m in markers)
    text = F.regexp_replace(text, rf"(?i)\s+(?:{marked})(?!\w).*$", "")
    head = F.trim(F.get(F.split(text, ","), F.lit(0)))
    text = F.when((head != "") & (F.char_length(head) <= most), head).otherwise(text)
    name = F.regexp_extract(text, rf"^\S+(?:\s+(?:(?i:{'|'.join(keepers)})(?=\s|$)|\p{{Lu}}\S*)){{0,{words - 1}}}", 0)
    return F.regexp_replace(name, r"^[ .,-]+|[ .,-]+$", "")


def null_tokens(c: Column, tokens: Sequence[str] = MISSING) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(*tokens), F.trim(c))


def parse_bool(c: Column) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)


def round_half_even(c: Column, digits: int = 2) -> Column:
    return F.bround(c, digits)


def ratio(n: Column, d: Column, k: float = 100.0) -> Column:
    """n / d * k; null where d is not above 0."""
    return n / F.when(d > 0, d) * k


def clamp(c: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        c = F.when(c < low, F.lit(low)).otherwise(c)
    return c if high is None else F.when(c > high, F.lit(high)).otherwise(c)


def parse_percent(c: Column, loose: bool = False) -> Column:
    """Percent cell: signs dropped, 0..1 scaled by 100, outside 0..100 null. loose: also drops brackets, words and n=, takes the first number."""
    text = F.trim(c)
    if loose:
        text = F.regexp_replace(F.lower(text), r"\(.*?\)|per\s*cent|n\s*=\s*\d+", "")
        text = F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1), F.lit(""))
    value = F.regexp_replace(F.when(~text.isin("", "-", "--", "*"), text), "[%,]", "").try_cast("double")
    scaled = F.when((value > 0) & (value <= 1) & ~F.contains(c, F.lit("%")), value * 100).otherwise(value)
    return F.when((scaled >= 0) & (scaled <= 100), scaled)


def rank_label(c: Column, order: Sequence[str] = ("low", "medium", "high")) -> Column:
    """1, 2, ... by place in `order`; 0 for anything else."""
    out = F.lit(0)
    for k, label in enumerate(order):
        out = F.when(F.lower(c) == label, F.lit(k + 1)).otherwise(out)
    return out


def title_label(c: Column) -> Column:
    """Title case for names in capitals longer than three letters."""
    return F.when((F.upper(c) == c) & (F.char_length(c) > 3), F.initcap(F.lower(c))).otherwise(c)


def pad_code(c: Column, size: int) -> Column:
    return F.lpad(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""), size, "0")


def split_list(c: Column, mark: str = ";") -> Column:
    return F.filter(F.transform(F.split(c, mark), lambda x: F.trim(x)), lambda x: x != "")


def join_list(c: Column, mark: str = "; ") -> Column:
    return F.array_join(c, mark)


def map_add(shares: Column, key: Column, delta: Column) -> Column:
    """Adds to one key of a share map (0 if absent), not below 0."""
    value = F.greatest(F.coalesce(F.try_element_at(shares, key), F.lit(0.0)) + delta, F.lit(0.0))
    return F.map_concat(F.map_filter(shares, lambda k, v: k != key), F.create_map(key, value))


def map_rescale(shares: Column, total: float = 100.0) -> Column:
    """Scales a share map to `total`; unchanged if its sum is 0."""
    now = F.aggregate(F.map_values(shares), F.lit(0.0), lambda a, x: a + x)
    return F.when(now > 0, F.transform_values(shares, lambda k, v: v * total / now)).otherwise(shares)


def anonymise_id(c: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), c.cast("string")), 256), 1, 12)


def signed_points(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%+.{digits}f points", c)


def sentence(template: str, *parts: Column) -> Column:
    """The template with its parts; null if one is."""
    whole = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    return F.when(whole, F.format_string(template, *parts))


def swing_sentence(name: str, c: Column, flat: float = 0.05, digits: int = 1) -> Column:
    """`name` rose or fell by so many points, or was stable within `flat`; null stays null."""
    by = F.format_string(f"%.{digits}f points", F.abs(c))
    return F.when(F.abs(c) <= flat, F.lit(f"{name} was stable.")).when(c > 0, F.concat(F.lit(f"{name} rose by "), by, F.lit("."))).when(c < 0, F.concat(F.lit(f"{name} fell by "), by, F.lit(".")))


def template_text(*parts: Column) -> Column:
    """The non-null sentences, joined by blanks."""
    return F.concat_ws(" ", *parts)


def months_between(newer: Column, older: Column) -> Column:
    return newer - older


def births_within(interview: Column, births: Column, months: int = 36) -> Column:
    """How many birth months lie at most `months` before the interview month."""
    return F.size(F.filter(births, lambda b: (interview - b >= 0) & (interview - b <= months)))


def weight_scale(rows: DataFrame, weight: str, limit: float = 1000.0, unit: float = 1e6) -> DataFrame:
    """Divides weights with implied decimals by `unit` if the largest is above `limit`."""
    top = rows.agg(F.max(weight).alias("m")).scalar()
    return rows.withColumn(weight, F.when(top > limit, F.col(weight) / unit).otherwise(F.col(weight)))


def label_by_thresholds(c: Column, bands: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first band whose bound the value reaches (bands in falling order); `otherwise` below all, null for null."""
    out = F.lit(otherwise)
    for bound, label in reversed(bands):
        out = F.when(c >= bound, F.lit(label)).otherwise(out)
    return F.when(c.isNotNull(), out)


def sign_label(c: Column, dead: float, up: str = "positive", flat: str = "near_zero", down: str = "negative") -> Column:
    """up or down outside a dead band; null counts as flat."""
    return F.when(c > dead, up).when(c < -dead, down).otherwise(flat)
