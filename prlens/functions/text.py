"""Text functions, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split sees it: Unicode white space and the four separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]+"
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"
#: Fixed patterns of the metric definitions.
BUG_FIX = r"(fix(e[sd])?|bug|defect|fault|error|crash|repair)"
BUG_LABEL = r"bug|defect|regression"
HASH_TAG = r"(?:^|\s)#[0-9]+"
AT_TAG = r"(?:^|[^A-Za-z0-9_.@/])@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
CONFLICT = r"(?i)conflict"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
TEST_FILE = r"(^|/)(tests?|specs?)/|_test\.|\.test\.|Test.*\.java"
BOT = r"\[bot\]$"


def words(c: Column) -> Column:
    """Words by white space; none for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda x: x != "")


def word_count(c: Column) -> Column:
    """Number of words; 0 for null or blank text."""
    return F.size(words(c)).cast("long")


def is_blank(c: Column) -> Column:
    """Whether a text is null or white space only."""
    return ~F.coalesce(c.rlike(NOT_SPACE), F.lit(False))


def english_title(c: Column, most: float = 0.3) -> Column:
    """Whether at most that share of a title's letters are outside the Latin script; titles without letters pass."""
    # runs of signs are taken out, which for mostly Latin texts is a few long ones; letters are counted only if others remain
    other = F.length(F.regexp_replace(c, r"[\p{IsLatin}\P{L}]+", ""))
    return F.coalesce((other == 0) | (other / F.length(F.regexp_replace(c, r"\P{L}+", "")) <= F.lit(most)), F.lit(True))


def strip_markdown(c: Column) -> Column:
    """Text without fenced blocks, inline code, images and links (whose texts stay) and URLs."""
    for pattern, to in ((r"(?s)```.*?(```|$)", " "), (r"`[^`]*`", " "), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"https?://\S+", " ")):
        c = F.regexp_replace(c, pattern, to)
    return c


def strip_code(c: Column) -> Column:
    """Text without fenced blocks and inline code."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)```.*?(```|$)", " "), r"`[^`]*`", " ")


def description_length(c: Column) -> Column:
    """Words of a description after its markup is stripped."""
    return word_count(strip_markdown(c))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it occurs in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ngrams(tokens: Column, *sizes: int) -> Column:
    """Runs of so many tokens, joined by blanks; all runs of the first size, then of the next."""

    def runs(w: Column) -> Column:
        one = lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.array(*[one(n) for n in sizes]))

    return once(tokens, runs)


def keyword_density(c: Column, lexicon: list[str]) -> Column:
    """Share of a text's lower-cased words that are in a lexicon; 0 without words."""
    return once(words(F.lower(c)), lambda w: F.when(F.size(w) == 0, F.lit(0.0)).otherwise(F.size(F.filter(w, lambda x: x.isin(lexicon))) / F.size(w)))


def changed_lines(patch: Column) -> Column:
    """Lines added or removed by a patch; only headers that come before the first hunk are left out. Lines end at a line feed only."""
    body = F.regexp_replace(patch, r"(?s)^(?:(?!@@ ).*?\n)(?=@@ )", "")
    return F.coalesce(F.regexp_count(body, F.lit(r"(?dm)^[+-]")) - F.when(body.rlike(r"(?dm)^@@ "), 0).otherwise(F.regexp_count(body, F.lit(r"(?dm)^(\+\+\+|---)( |$)"))), F.lit(0)).cast("long")


def diff_hunks(patch: Column) -> Column:
    """Hunks of a patch."""
    return F.coalesce(F.regexp_count(patch, F.lit(r"(?dm)^@@ ")), F.lit(0)).cast("long")


#: Tags of language names that letters and digits alone would confuse.
LANGUAGE_TAGS = {"c++": "cpp", "c#": "csharp", "python": "py"}
#: What a tag of any other name leaves out.
NOT_TAG = r"[^\p{L}\p{N}]"


def language_tag(c: Column) -> Column:
    """A language's tag in names: a special one, else the lower-cased name's letters and digits."""
    low = F.lower(F.trim(c))
    special = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_TAGS.items() for x in kv]), low)
    return F.coalesce(special, F.regexp_replace(low, NOT_TAG, ""))


#: Aliases of organisations, and e-mail providers that tell of none.
ALIASES = {"msft": "microsoft"}
PROVIDERS = ("gmail.com", "outlook.com", "users.noreply.github.com")


def affiliation(company: Column, aliases: dict[str, str] | None = None) -> Column:
    """A company name in lower case without @, marks and legal forms, by its main name where it is an alias; null if nothing is left."""
    low = F.regexp_replace(F.lower(F.trim(company)), r"[^\p{L}\p{N}\s]", "")
    bare = F.nullif(F.trim(F.regexp_replace(low, r"\b(inc|llc|ltd|gmbh|corp|corporation|co|company)\b", "")), F.lit(""))
    known = ALIASES if aliases is None else aliases
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), bare), bare) if known else bare


def is_bot(login: Column, known: tuple[str, ...] = ()) -> Column:
    """Whether a login is a bot's."""
    return F.coalesce(login.rlike(BOT) | login.isin(*known) if known else login.rlike(BOT), F.lit(False))


def mentions(c: Column, lexicon: list[str]) -> Column:
    """Whether a text holds one of the lexicon's phrases as words."""
    import re

    return F.coalesce(c.rlike(r"(?i)\b(?:" + "|".join(map(re.escape, lexicon)) + r")\b"), F.lit(False)) if lexicon else F.lit(False)
