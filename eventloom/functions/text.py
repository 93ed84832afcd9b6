"""Column functions over log text and list strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.arrays import bind

# Patterns and formats that must equal the ones the log corpus is read with.
HEADER = r"^(.+?)\s+(.+?)\s+(.+?)\s+(.+?)\s+(.+?):\s+(.+?)$"
HEADER_FIELDS = ("date", "time", "pid", "level", "component", "content")
BLOCK_ID = r"(blk_[A-Za-z0-9_-]+)"
UNKNOWN_BLOCK = "unknown_block"
MASKS = (
    (r"((?<=[^A-Za-z0-9])|^)(([0-9a-f]{2,}:){3,}([0-9a-f]{2,}))((?=[^A-Za-z0-9])|$)", "<:ID:>"),
    (r"((?<=[^A-Za-z0-9])|^)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})((?=[^A-Za-z0-9])|$)", "<:IP:>"),
    (r"((?<=[^A-Za-z0-9])|^)([0-9a-f]{6,} ?){3,}((?=[^A-Za-z0-9])|$)", "<:SEQ:>"),
    (r"((?<=[^A-Za-z0-9])|^)([0-9A-F]{4} ?){4,}((?=[^A-Za-z0-9])|$)", "<:SEQ:>"),
    (r"((?<=[^A-Za-z0-9])|^)(0x[a-f0-9A-F]+)((?=[^A-Za-z0-9])|$)", "<:HEX:>"),
    (r"((?<=[^A-Za-z0-9])|^)([\-\+]?\d+)((?=[^A-Za-z0-9])|$)", "<:NUM:>"),
    (r'(?<=executed cmd )(".+?")', "<:CMD:>"),
)
RUN_NAME = r"\Atoken_e(\d+)_h(\d+)_l(\d+)_d(\d+)\z"
REQUEST_ID = r"\A[A-Za-z0-9._-]+\z"
REQUEST_ID_MAX = 64
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}

# All characters that count as whitespace, and the same set as a pattern.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE = r"[\s\x1c-\x1f]"
_DARK = r"[^\s\x1c-\x1f]"
_GAP = "\x01"
# HEADER in linear time. The lazy form tries every split of a line that has no header; here each of the first
# four fields is one word or, to get past a line break, the rest of its line, and is never split otherwise.
_FIELD = rf"((?>{_DARK}+)|(?>[^\n]*{_DARK})){_SPACE}++"
_LINEAR_HEADER = rf"(?dU)\A{_FIELD * 4}({_DARK}.*?):{_SPACE}++([^\n]++)\z"


def strip(c: Column) -> Column:
    """Remove whitespace of any kind at both ends (plain ``trim`` would only remove spaces)."""
    return F.btrim(c, F.lit(WHITESPACE))


def drop_undecodable(c: Column) -> Column:
    """Text with undecodable bytes left out."""
    return F.regexp_replace(F.make_valid_utf8(c), "�", "")


def header_cut(text: Column) -> Column:
    """Array of ``matched`` mark and the six header fields of stripped text; other text as one item.

    A single replacement marks the field borders and a split reads them, so the pattern runs once per line.
    """
    marked = _GAP + _GAP.join(f"${i}" for i in range(1, 7))
    cut = F.split(F.regexp_replace(text, _LINEAR_HEADER, marked), _GAP, 7)
    rare = F.when(text.rlike(_LINEAR_HEADER), F.array(F.lit(""), *[F.regexp_extract(text, _LINEAR_HEADER, i) for i in range(1, 7)]))
    return F.when(text.contains(_GAP), F.coalesce(rare, F.array(text))).otherwise(cut)


def header_fields(cut: Column) -> dict[str, Column]:
    """The header fields by name; text without header is all ``content``."""
    matched = F.size(cut) == 7
    fields = {name: F.when(matched, F.get(cut, F.lit(i + 1))) for i, name in enumerate(HEADER_FIELDS[:-1])}
    return {**fields, "content": F.when(matched, F.get(cut, F.lit(6))).otherwise(F.get(cut, F.lit(0)))}


def first_block_id(text: Column, unknown: str | None = None) -> Column:
    """First block id in ``text``; without one null, or ``unknown``."""
    found = F.nullif(F.regexp_extract(text, BLOCK_ID, 1), F.lit(""))
    return found if unknown is None else F.coalesce(found, F.lit(unknown))


def header_timestamp(date: Column, time: Column) -> Column:
    """Timestamp of ``yymmdd`` and ``HHMMSS``; null when invalid. Years 69-99 belong to the last century."""
    century = F.when(F.substring(date, 1, 2) >= "69", F.lit("19")).otherwise(F.lit("20"))
    well_formed = date.rlike(r"\A\d{6}\z") & time.rlike(r"\A\d{6}\z")
    return F.when(
        well_formed, F.try_to_timestamp(F.concat(century, date, F.lit(" "), time), F.lit("yyyyMMdd HHmmss"))
    )


# What a text must contain for a mask to apply, in the order of the masks: cheap tests that spare most lines
# most of the patterns. Numbers are looked for always.
_MASK_HINTS = (
    lambda t: t.like("%:%:%:%"),
    lambda t: t.like("%.%.%.%"),
    lambda t: t.rlike("[0-9a-f]{6}"),
    lambda t: t.rlike("[0-9A-F]{4} ?[0-9A-F]{4}"),
    lambda t: t.contains("0x"),
    None,
    lambda t: t.contains("executed cmd "),
)


def mask(text: Column) -> Column:
    """Replace ids, addresses, hex runs, numbers and commands by marks, in this order."""
    for (pattern, mark), hint in zip(MASKS, _MASK_HINTS, strict=True):
        text = _mask_where(text, pattern, mark, hint)
    return text


def _mask_where(text: Column, pattern: str, mark: str, hint: Callable[[Column], Column] | None) -> Column:
    if hint is None:
        return F.regexp_replace(text, pattern, mark)
    return bind(text, lambda t: F.when(hint(t), F.regexp_replace(t, pattern, mark)).otherwise(t))


def tokens(text: Column) -> Column:
    """Whitespace-separated tokens of ``text``."""
    return F.filter(F.split(text, rf"(?U){_SPACE}+"), lambda t: t != "")


def list_items(text: Column) -> Column:
    """Items of ``[a, b]``: null gives an empty array, brackets count only in pairs, empty items are dropped."""
    stripped = strip(text)
    inner = F.when(
        stripped.startswith("[") & stripped.endswith("]") & (F.length(stripped) >= 2),
        F.regexp_replace(stripped, r"(?s)\A\[(.*)\]\z", "$1"),
    ).otherwise(stripped)
    items = F.filter(F.transform(F.split(inner, ","), strip), lambda x: x != "")
    return F.coalesce(items, F.array().cast("array<string>"))


def list_numbers(text: Column) -> Column:
    """``list_items`` as doubles; text that is not a number raises under ANSI mode."""
    return F.transform(list_items(text), lambda x: x.cast("double"))


def anomaly_flag(label: Column) -> Column:
    """1 when the label says anomaly, ignoring case and outer whitespace; else 0."""
    return F.coalesce((F.lower(strip(label)) == "anomaly").cast("int"), F.lit(0))


def strict_label(label: Column) -> Column:
    """0 for Normal, 1 for Anomaly; any other label raises."""
    encoded = F.when(label == "Normal", 0).when(label == "Anomaly", 1)
    return F.coalesce(encoded, F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))).cast("int"))


def run_name_parts(name: Column) -> Column:
    """Struct of the settings that a run name spells out; nulls when the name has another form."""
    part = [F.nullif(F.regexp_extract(name, RUN_NAME, i), F.lit("")).cast("int") for i in range(1, 5)]
    return F.struct(
        part[0].alias("embedding_dim"),
        part[1].alias("hidden_size"),
        part[2].alias("num_layers"),
        (part[3] / 10).alias("dropout"),
    )


def valid_request_id(request_id: Column) -> Column:
    """Whether a request id from outside may be kept."""
    return F.coalesce((F.length(request_id) <= REQUEST_ID_MAX) & request_id.rlike(REQUEST_ID), F.lit(False))


def kept_request_id(request_id: Column) -> Column:
    return F.when(valid_request_id(request_id), request_id).otherwise(F.uuid())


def severity(status: Column) -> Column:
    """Log level of a response status."""
    return F.when(status >= 500, "error").when(status >= 400, "warning").otherwise("info")


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps, to three places."""
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 1000, 3)


def limit_amount(text: Column) -> Column:
    """Number of requests in ``30 per minute``."""
    return F.regexp_extract(text, r"^\s*(\d+)", 1).cast("int")


def limit_seconds(text: Column) -> Column:
    """Window length in seconds of ``30 per minute``, also ``5 per 2 hours`` and ``10/day``."""
    pattern = r"^\s*\d+\s*(?:/|per)\s*(\d*)\s*(second|minute|hour|day)s?\s*$"
    many = F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int"), F.lit(1))
    unit = F.regexp_extract(text, pattern, 2)
    seconds = F.lit(None).cast("int")
    for name, value in UNIT_SECONDS.items():
        seconds = F.when(unit == name, F.lit(value)).otherwise(seconds)
    return many * seconds
