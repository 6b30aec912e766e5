"""Column functions over label text: qualifiers, bilingual names, variants, tokens, clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("parenthetical", "raw", "stripped")
TOKEN = r"([\p{L}\p{N}_]+)"
QUALIFIED = r"(?s)^(.*?),(\S.*)$"


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"qualifier mode {mode!r} is none of {', '.join(MODES)}")
    return mode


def base_term(term: Column, qualifier: Column | None = None) -> Column:
    """The term without its qualifier: before the first comma that a non-space follows, or before a given qualifier at the end."""
    own = F.when(term.rlike(QUALIFIED), F.regexp_extract(term, QUALIFIED, 1)).otherwise(term)
    if qualifier is None:
        return own
    ends = qualifier.isNotNull() & (qualifier != "") & term.endswith(F.concat(F.lit(" "), qualifier))
    return F.when(ends, F.substring(term, F.lit(1), F.length(term) - F.length(qualifier) - 1)).otherwise(own)


def qualifier_of(term: Column, qualifier: Column | None = None) -> Column:
    """The qualifier, or null."""
    own = F.when(term.rlike(QUALIFIED), F.regexp_extract(term, QUALIFIED, 2))
    if qualifier is None:
        return own
    ends = qualifier.isNotNull() & (qualifier != "") & term.endswith(F.concat(F.lit(" "), qualifier))
    return F.when(ends, qualifier).otherwise(own)


def join_term(base: Column, qualifier: Column, separator: Column | str, mode: str) -> Column:
    check_mode(mode)
    sep = F.lit(separator) if isinstance(separator, str) else separator
    if mode == "stripped":
        return base
    joined = F.concat(base, sep, qualifier) if mode == "raw" else F.concat(base, F.lit(" ("), qualifier, F.lit(")"))
    return F.when(qualifier.isNull(), base).otherwise(joined)


def render_term(term: Column, mode: str, qualifier: Column | None = None) -> Column:
    found = qualifier_of(term, qualifier)
    given = F.lit(False) if qualifier is None else qualifier.isNotNull() & (qualifier != "") & term.endswith(F.concat(F.lit(" "), qualifier))
    return join_term(base_term(term, qualifier), found, F.when(given, F.lit(" ")).otherwise(F.lit(",")), mode)


def bilingual(german: Column, english: Column) -> Column:
    same = english.isNull() | (english == "") | (english == german)
    return F.when(same, german).otherwise(F.concat_ws(" / ", german, english))


def label_text(group: Column, name: Column, synonyms: Column, definition: Column | None = None) -> Column:
    """Marked lines for the fields that are there."""
    line = lambda mark, text: F.when(text.isNotNull() & (text != ""), F.concat(F.lit(f"{mark}: "), text))
    lines = [line("Fachgebiet", group), line("Schlagwort", name), line("Synonyme", F.array_join(synonyms, "; "))]
    if definition is not None:
        lines.append(line("Definition", definition))
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def config_label(form: str, term: Column, mode: str, english: Column, group: Column, synonyms: Column, definition: Column | None = None) -> Column:
    """A label in the form that a configuration names: its bilingual name alone, or the marked text around it."""
    name = bilingual(render_term(term, mode), english)
    if form == "name":
        return name
    if form == "text":
        return label_text(group, name, synonyms, definition)
    raise ValueError(f"label form {form!r} is neither name nor text")


def variants(name: Column, english: Column, synonyms: Column) -> Column:
    """Names to match: the rendered name, its English, the synonyms; blanks and repeats dropped, order kept."""
    return F.array_distinct(F.filter(F.concat(F.array(name, english), synonyms), lambda x: x.isNotNull() & (x != "")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def clipped(text: Column, limit: int) -> Column:
    """At most `limit` characters, then a mark; no limit at 0 or below."""
    if limit <= 0:
        return text
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit(" […]"))).otherwise(text)


def one_line(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), " · ")


def language_code(uri: Column) -> Column:
    """The last path segment of a language URI."""
    return F.regexp_extract(F.regexp_replace(F.trim(uri), "/+$", ""), "[^/]*$", 0)


def subject_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def record_text(title: Column, abstract: Column) -> Column:
    return F.regexp_replace(F.concat_ws(" ", title, abstract), r"^\s+|\s+$", "")


def stem_name(path: Column) -> Column:
    """A file's name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"\.[^.]*$", "")


def schedule(step: Column, planned: int, warmup: float) -> Column:
    """Learning-rate factor: linear warm-up over a share of the planned steps, then linear decay to 0."""
    first = max(1, int(planned * warmup))
    return F.when(step < first, (step + 1) / first).otherwise(F.greatest(F.lit(0.0), (F.lit(planned) - step) / max(1, planned - first)))
