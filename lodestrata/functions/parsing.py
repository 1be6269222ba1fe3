"""Parsing of questions and review records, by rules whose vocabularies are data: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " \t\n\r\x00\x0b"
#: Fixed values of review records.
VERDICTS = ("correct", "mostly_correct", "partially_correct", "incorrect", "unsafe")
SCORES = ("overall_score", "legal_accuracy_score", "norm_coverage_score", "case_law_score", "source_routing_score", "clarity_score")


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match of a pattern, null if there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group), F.lit(""))


# Parts that patterns of questions are put together from.
GAP, SPACE, EDGE = "[ \t\n\r\f]*", "[ \t\n\r\f]+", r"\b"


def digits(least: int, most: int | None = None) -> str:
    return f"[0-9]{{{least},{'' if most is None else most}}}"


def held(part: str) -> str:
    return f"({part})"


def optional(*parts: str) -> str:
    return f"(?:{''.join(parts)})?"


def alone(*parts: str) -> str:
    """Parts with a word's edge on both sides."""
    return EDGE + "".join(parts) + EDGE


#: A year of the last century or this one.
YEAR = f"(?:{'|'.join(('19', '20'))}){digits(2, 2)}"


def case_number(text: Column) -> Column:
    """Up to four capitals, a dash or slash and a number, with what stands in brackets behind it."""
    register, serial, bracket = "[A-Z]{1,4}", "[-/]" + digits(1), r"\([^)]+\)"
    return F.btrim(found(text, register + serial + optional(GAP, bracket)), F.lit(BLANK))


def application_number(text: Column) -> Column:
    """A number, a slash and a year of two to four digits."""
    return found(text, alone(held("/".join((digits(4, 6), digits(2, 4))))), 1)


def year_range(text: Column, as_of: int, earliest: int = 1990) -> tuple[Column, Column]:
    """(from, to): of a range its ends, else the first year alone; years outside ``earliest`` to ``as_of`` are null."""
    dash = GAP + "[-–]" + GAP
    both = alone(held(YEAR), dash, held(YEAR))
    valid = lambda y: F.when(y.cast("int").between(earliest, as_of), y.cast("int"))
    return valid(F.coalesce(found(text, both, 1), found(text, alone(held(YEAR)), 1))), valid(found(text, both, 2))


def first_named(text: Column, signals: list[tuple[str, str]]) -> Column:
    """The name of the first signal, in the list's order, that the text contains; null if none."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(None).cast("string")
    for signal, name in reversed(signals):
        out = F.when(low.contains(signal), name).otherwise(out)
    return out


def judge(text: Column) -> Column:
    """The name behind the title, as far as letters and blanks go, of four to forty characters."""
    title, letters = "[Jj]udge", "[a-zA-Z \t\n\r\f]{2,30}"
    name = F.btrim(found(text, EDGE + title + SPACE + held("[A-Z]" + letters), 1), F.lit(BLANK))
    return F.when(F.length(name).between(4, 40), name)


def law_name(text: Column, anchors: dict[str, str], skipped: tuple[str, ...] = (), most: int = 3) -> Column:
    """A law's name: the first word that is an anchor, in its base form, with up to ``most`` words before it, but for
    skipped ones; each with a capital."""
    words = F.filter(F.split(F.lower(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))), r"[ \t\n\r\f]+"), lambda w: w != "")
    base = F.create_map(*(F.lit(x) for pair in anchors.items() for x in pair))
    is_anchor = F.transform(words, lambda w: w.isin(*anchors).cast("int"))
    at = F.array_position(is_anchor, 1).cast("int")
    before = F.filter(F.slice(words, F.greatest(at - most, F.lit(1)), F.least(at - 1, F.lit(most))), lambda w: ~w.isin(*skipped) if skipped else F.lit(True))
    return F.when(at > 0, F.when(F.size(before) == 0, base[F.element_at(words, at)]).otherwise(F.initcap(F.concat_ws(" ", F.array_join(before, " "), base[F.element_at(words, at)]))))


def article_number(text: Column, word: str = "article") -> Column:
    """The number behind the word, else the number before it."""
    low = F.lower(F.coalesce(text, F.lit("")))
    number, ordinal = held(digits(1)), optional("|".join(("st", "nd", "rd", "th")))
    return F.coalesce(found(low, word + SPACE + number, 1), found(low, number + optional("[–-]") + ordinal + GAP + word, 1))


def convention_article(text: Column, signals: list[tuple[str, str]]) -> Column:
    """By a signal, else article 1 to 60 by number, else a protocol's article (P1-1)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    one = held(digits(1, 1))
    protocol, numbered = alone("p", one, "-", one), alone("article", SPACE, held(digits(1, 2)))
    return F.coalesce(first_named(text, signals), found(low, numbered, 1), F.concat(F.lit("P"), found(low, protocol, 1), F.lit("-"), found(low, protocol, 2)))


def hierarchy_level(category: Column, title: Column, levels: list[tuple[str, int]], default: int = 3) -> Column:
    """The level of the first keyword that category or title contains."""
    low, out = F.lower(F.concat_ws(" ", category, title)), F.lit(default)
    for keyword, level in reversed(levels):
        out = F.when(low.contains(keyword), level).otherwise(out)
    return out


def specificity_level(title: Column, general: list[str]) -> Column:
    """2 for general and codified texts, 1 for others."""
    low, out = F.lower(F.coalesce(title, F.lit(""))), F.lit(False)
    for g in general:
        out = out | low.contains(g)
    return F.when(out, 2).otherwise(1)


def effective_year(adopted: Column, as_of: int, earliest: int = 1991) -> Column:
    """The year of a date or of a text's first four digits, null outside the years that count."""
    year = F.regexp_extract(F.substring(adopted.cast("string"), 1, 4), "^[0-9]+", 0)
    return F.when(F.nullif(year, F.lit("")).cast("int").between(earliest, as_of), year.cast("int"))


def labelled_issue(text: Column, cues: list[str], noise: str | None = None) -> Column:
    """What a line says behind a cue and its colon, or, if nothing, the next line that is not empty; null without a cue.
    ``noise``: a pattern that goes, with all behind it in its line."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda s: F.btrim(s, F.lit(BLANK))), lambda s: s != "")

    def has_cue(line: Column) -> Column:
        out = F.lit(False)
        for c in cues:
            out = out | F.lower(line).contains(c)
        return out

    at = F.array_position(F.transform(lines, lambda s: has_cue(s).cast("int")), 1).cast("int")
    cue = F.element_at(lines, at)
    behind = F.btrim(F.regexp_extract(cue, r"^[^:：]*[:：](.*)$", 1), F.lit(BLANK))
    issue = F.when(at > 0, F.when(behind != "", behind).otherwise(F.try_element_at(lines, at + 1)))
    return issue if noise is None else F.btrim(F.regexp_replace(issue, rf"[ \t\n\r\f]*{noise}.*", ""), F.lit(BLANK))


def use_focused(question: Column, focused: Column, level: Column, short: int = 500, least: int = 700, share: float = 0.85) -> Column:
    """Whether a focused query replaces the question: it is another text, the question is long or hard, and the query is
    not nearly as long."""
    plain = lambda c: F.lower(F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\n\r\f]+", " ")))
    long_ = F.length(F.btrim(F.coalesce(question, F.lit("")), F.lit(BLANK)))
    given = F.length(F.btrim(F.coalesce(focused, F.lit("")), F.lit(BLANK)))
    return (plain(focused) != "") & (plain(question) != plain(focused)) & ~((long_ <= short) & (level != "full")) & (given <= F.greatest(F.lit(least), F.floor(long_ * share)))


def context_text(excerpt: Column, full: Column, role: Column, mode: Column, total: Column, most: int = 7000) -> tuple[Column, Column]:
    """(text, strategy) of a decision for an answer, by its role, the mode and the number of decisions."""
    excerpt, full = F.coalesce(excerpt, F.lit("")), F.coalesce(full, F.lit(""))
    matched, whole = F.when(excerpt != "", excerpt).otherwise(full), F.when(full != "", full).otherwise(excerpt)
    cut = lambda text, n: F.substring(text, F.lit(1), n if isinstance(n, Column) else F.lit(n))
    supporting, compact = F.coalesce(role == "supporting", F.lit(False)), (mode == "find") | (total > 5)
    primary, summary, compare = (total > 3) & (mode != "summarize"), mode == "summarize", mode == "compare"
    fits = (excerpt != "") & (F.length(excerpt) <= most)
    room = most - F.length(excerpt)
    extra = F.when(room > 500, cut(full, room)).otherwise("")
    more = F.concat(excerpt, F.when(extra != "", F.concat(F.lit("\n\n---\n"), extra)).otherwise(""))
    size = F.when(F.length(full) > most, "TRUNCATED").otherwise("FULL")
    text = F.when(supporting, cut(matched, F.when(mode == "find", 1200).otherwise(2000))).when(compact, cut(matched, 1200)).when(primary, cut(matched, most)).when(summary, cut(whole, most))
    text = text.when(compare, cut(matched, F.when(total <= 2, 3500).otherwise(2000))).when(fits, more).otherwise(cut(matched, most))
    name = F.when(supporting, "SUPPORTING-COMPACT").when(compact, "COMPACT").when(primary, "PRIMARY-CONTEXT").when(summary, size).when(compare, "COMPARE").when(fits, "MATCHED+CONTEXT").otherwise(size)
    return text, name


def styled(query: Column, style: Column, templates: dict[str, str], category: Column) -> Column:
    """A query in a style: a template's {query} and {category} filled in, the line of an empty category left out; the
    trimmed query itself for other styles."""
    plain, named = F.btrim(query, F.lit(BLANK)), F.btrim(F.coalesce(category, F.lit("")), F.lit(BLANK))
    out = plain
    for name, template in templates.items():
        filled = F.replace(F.lit(template), F.lit("{query}"), plain)
        filled = F.replace(filled, F.lit("{category}"), F.when(named != "", F.concat(F.lit("\nCategory: "), named)).otherwise(""))
        out = F.when(style == name, F.btrim(filled, F.lit(BLANK))).otherwise(out)
    return out


def labels(value: Column, names: dict[str, str]) -> Column:
    """A value's label; the value itself if it has none."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), value), value)


def active(flags: dict[str, Column]) -> Column:
    """The names of the flags that are set, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())))


def due(last: Column, now: Column, days: int = 30) -> Column:
    """Whether something was never done or not within so many days."""
    return last.isNull() | (F.floor((F.unix_timestamp(now) - F.unix_timestamp(last)) / 86400) >= days)


def review_faults(columns: dict[str, Column]) -> Column:
    """What is wrong with a review: the names of scores outside 1 to 10, of a missing overall score, of an unknown or
    missing verdict, of a name or notes that are too long."""
    none = F.lit(None)
    get = lambda name: columns.get(name, none)
    faults = [F.when((get(n).isNull() if n == "overall_score" else F.lit(False)) | ~F.coalesce(get(n).cast("int").between(1, 10), F.lit(True)), n) for n in SCORES]
    faults.append(F.when(~F.coalesce(get("verdict").isin(*VERDICTS), F.lit(False)), "verdict"))
    faults += [F.when(F.coalesce(F.length(get(n).cast("string")) > most, F.lit(False)), n) for n, most in (("reviewer_name", 120), ("notes", 8000))]
    return F.array_compact(F.array(*faults))
