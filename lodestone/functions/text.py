"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words too common in names to relate two of them.
GENERIC = frozenset("new get set is has to from into with as of for and or the run make build create parse read write load save init start stop add remove update check find item value data info list".split())


def words_of(name: Column) -> Column:
    """Words of an identifier: cut at `_`, `-` and before a capital after a small letter or digit, lower case, longer than one letter. Null gives null."""
    spread = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(spread), "[_-]+"), lambda w: F.length(w) > 1)


def label_words(label: Column, stop: frozenset[str] = GENERIC) -> Column:
    """Words of a scope label: the part after the last `::` cut at `_`, longer than two bytes, without common words."""
    return F.filter(F.split(F.substring_index(label, "::", -1), "_"), lambda w: (F.octet_length(w) > 2) & ~w.isin(*sorted(stop)))


def normalize_doc(text: Column) -> Column:
    """Letters and digits in lower case, anything else as single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def sanitize(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s()]", "_")


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "::", -1)


def top_module(path: Column) -> Column:
    return F.substring_index(path, "::", 1)


def module_of(path: Column) -> Column:
    """What stands before the last `::`; empty for a bare name."""
    return F.regexp_extract(path, r"^(.*)::[^:]*$", 1)


def dir_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def glob_like(name: Column, pattern: str) -> Column:
    """Whether a qualified name matches a glob in which only `*` is special: a bare pattern is held against the last segment, one with `::` against any suffix of whole segments. Small letters match either case, a pattern with capitals only its own."""
    import re

    body = "".join(".*" if p == "*" else re.escape(p) for p in re.split(r"(\*)", pattern))
    case = "" if pattern != pattern.lower() else "(?i)"
    head = "(^|.*::)" if "::" in pattern else ""
    return (name if "::" in pattern else last_segment(name)).rlike(f"{case}^{head}{body}$")


def key_matches(waiver_key: Column, finding_key: Column) -> Column:
    """A waiver without key covers every finding; one with a key covers findings whose key equals it, ends in it as last segment or has it as the part before `::`. A finding without key is covered by waivers without key alone."""
    return waiver_key.isNull() | (finding_key.isNotNull() & ((finding_key == waiver_key) | (last_segment(finding_key) == waiver_key) | finding_key.startswith(F.concat(waiver_key, F.lit("::")))))


def move_key(check: Column, label: Column) -> Column:
    """What a finding keeps when its place changes: the check and the last segments of its label's parts."""
    return F.concat_ws("\u0001", check, F.array_join(F.transform(F.split(label, r" \| "), last_segment), " | "))


def looks_like_logging(text: Column) -> Column:
    return text.rlike("log|warn|error!|debug|trace|info!|println|^eprint")


def return_shape(signature: Column) -> Column:
    after = F.substring_index(signature, "->", -1)
    return F.when(~signature.contains("->"), "()").when(after.contains("Result"), "Result").when(after.contains("Option"), "Option").otherwise("value")


def positional(words: Column, word: Column) -> Column:
    """Whether a word is the first or the last of a name's words."""
    return (F.get(words, F.lit(0)) == word) | (F.get(words, F.size(words) - 1) == word)


def kleene_all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def kleene_any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def not_stripped(cfg: Column) -> Column:
    """Items go only where their condition is definitely false; unknown (null) stays."""
    return F.coalesce(cfg, F.lit(True))
