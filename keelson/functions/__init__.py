"""Scalar expressions on paths, texts, dates and numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Crates that come with the language.
BUILTIN_CRATES = ("std", "core", "alloc", "proc_macro")


def join_path(a: Column, b: Column) -> Column:
    """a::b without empty parts; empty if both are."""
    return F.concat_ws("::", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def parent_of(path: Column) -> Column:
    """What stands before the last ::, null without one."""
    return F.nullif(F.regexp_extract(path, r"^(.*)::[^:]+$", 1), F.lit(""))


def leaf(path: Column) -> Column:
    return F.substring_index(path, "::", -1)


def head(path: Column) -> Column:
    return F.substring_index(path, "::", 1)


def segments(path: Column) -> Column:
    return F.split(path, "::")


def prefixes(path: Column, least: Column | int = 1) -> Column:
    """The path and all its ancestors of at least `least` segments, longest first."""
    parts = segments(path)
    least = F.lit(least) if isinstance(least, int) else least
    shorter = F.filter(F.reverse(F.sequence(F.lit(1), F.size(parts))), lambda n: (n == F.size(parts)) | (n >= least))
    return F.transform(shorter, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "::"))


def extern_key(path: Column) -> Column:
    """Two segments for crates of the language, else the crate."""
    return F.when(head(path).isin(*BUILTIN_CRATES), F.substring_index(path, "::", 2)).otherwise(head(path))


def target_name(mod_id: Column, project: Column) -> Column:
    """Name of the unit behind a module id: `(bin:x)` and `(test:x)` give x, else the project."""
    named = F.regexp_extract(mod_id, r"^\((?:bin|test):(.*)\)$", 1)
    return F.when(named != "", named).otherwise(F.replace(project, F.lit("-"), F.lit("_")))


def relative_file(path: Column, crate_dir: str) -> Column:
    """Relative to src/, or ../x for other files of the crate; others as they are."""
    src, top = f"{crate_dir.rstrip('/')}/src/", f"{crate_dir.rstrip('/')}/"
    return (
        F.when(F.startswith(path, F.lit(src)), F.substr(path, F.lit(len(src) + 1)))
        .when(F.startswith(path, F.lit(top)), F.concat(F.lit("../"), F.substr(path, F.lit(len(top) + 1))))
        .otherwise(path)
    )


def starts_with_any(text: Column, prefixes: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(text, F.lit(p)) for p in prefixes], F.lit(False))


def ends_with_any(text: Column, suffixes: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(text, F.lit(s)) for s in suffixes], F.lit(False))


def capitalise(text: Column) -> Column:
    """First letter upper, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def title_case(text: Column) -> Column:
    """`my-tool_name` becomes `My Tool Name`."""
    words = F.filter(F.split(F.translate(text, "-_", "  "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, capitalise), " ")


def plural(n: Column, word: str) -> Column:
    """`1 file`, `2 files`."""
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def escape_for_script(json: Column) -> Column:
    """JSON that is safe inside a script element and still the same JSON."""
    return F.replace(F.replace(json, F.lit("</"), F.lit("<\\u002F")), F.lit("<!"), F.lit("<\\u0021"))


def escape_html(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def fingerprint(rule: Column, from_id: Column, to_id: Column) -> Column:
    """Twelve hex digits for rule|from|to; an absent end counts as empty."""
    return F.substring(F.sha1(F.concat_ws("|", rule, from_id, F.coalesce(to_id, F.lit("")))), 1, 12)


def _dated(epoch: Column, rest: str) -> Column:
    """The year of epoch seconds, four digits or as many as it has, and what the pattern `rest` makes of them."""
    at = F.timestamp_seconds(epoch)
    year = F.year(at)
    digits = year.cast("string")
    return F.concat(F.when(year.between(0, 9999), F.lpad(digits, 4, "0")).otherwise(digits), F.date_format(at, rest))


def iso_stamp(epoch: Column) -> Column:
    return _dated(epoch, "-MM-dd'T'HH:mm:ss'Z'")


def civil_date(epoch: Column) -> Column:
    return _dated(epoch, "-MM-dd")


def churn_score(commits: Column, dependents: Column) -> Column:
    return commits * (1 + dependents)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def number_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def names_self(ret: Column) -> Column:
    """Whether a return type has Self as a word."""
    return F.coalesce(ret.rlike(r"(^|[^\w])Self([^\w]|$)"), F.lit(False))


def percent_decoded(text: Column) -> Column:
    """%xx and + of a query string; what is no two hex digits stays as it is."""
    kept = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(kept)
