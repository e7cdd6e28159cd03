"""Text functions as Column builders: tokens, identifiers, lengths, prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns and words.
TOKEN = "[A-Za-z_][\\p{L}\\p{N}_$]+"
SUB_TOKEN = "[A-Z]+(?=[A-Z][a-z])|[A-Z][a-z]+|[a-z]+|[A-Z]+|\\p{Nd}+"
IDENTIFIER_STOP = (
    "where what when does with from this that which used call calls file files function defined definition class interface type setup how are the and for into across handler "
    "implementation usage schema"
).split()


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """Each identifier in lower case and, if it has two or more parts (camel case, snake case, digits), those too; repeats stay."""

    def parts(token: Column) -> Column:
        subs = F.filter(F.regexp_extract_all(token, F.lit(SUB_TOKEN), F.lit(0)), lambda s: F.length(s) >= 2)
        split = F.element_at(
            F.transform(F.array(subs), lambda s: F.when(F.size(s) > 1, F.concat(F.array(F.lower(token)), F.transform(s, F.lower))).otherwise(F.array(F.lower(token)))), 1
        )
        # a plain word has a single part: most tokens end here
        return F.when(token.rlike("^[A-Z]?[a-z]+$"), F.array(F.lower(token))).otherwise(split)

    return F.flatten(F.transform(raw_tokens(text), parts))


def identifiers(text: Column) -> Column:
    """Distinct whole identifiers of four or more characters that aren't everyday query words."""
    return F.array_distinct(F.filter(F.transform(raw_tokens(text), F.lower), lambda t: (F.length(t) >= 4) & ~t.isin(IDENTIFIER_STOP)))


def indexed_text(symbol: Column, text: Column, null_symbol: str = "None") -> Column:
    """What lexical search sees of a chunk; a null symbol is the word None."""
    return F.concat_ws(" ", F.coalesce(symbol, F.lit(null_symbol)), text)


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def context_prefix(source_type: Column, repo: Column, file_name: Column, symbol: Column, body: Column) -> Column:
    """The text that is embedded (not stored): one line about where the chunk is from, then its first 4,000 characters."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.concat_ws(" | ", empty(source_type), empty(repo), empty(file_name), empty(symbol)), F.lit("\n"), F.left(body, F.lit(4000)))


def passage(text: Column) -> Column:
    return F.concat(F.lit("passage: "), text)


def question(text: Column) -> Column:
    return F.concat(F.lit("query: "), text)


def lines(text: Column) -> Column:
    """As str.splitlines: every line end, no empty line behind the last."""
    parts = F.split(text, "\\R|[\\x1c-\\x1e]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def words_in(line: Column) -> Column:
    return F.regexp_count(line, F.lit("(?U)\\S+"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_sha(content: Column) -> Column:
    return F.sha1(content)


def session_sha(text: Column) -> Column:
    return F.left(F.sha1(text.cast("binary")), F.lit(16))


def snippet(text: Column, size: int = 400) -> Column:
    """One line of a hit for display."""
    return F.concat(F.regexp_replace(F.left(text, F.lit(size)), "\\n", " "), F.when(F.length(text) > size, "…").otherwise(""))


def points(delta: Column) -> Column:
    """A difference of shares as percentage points."""
    return F.when(delta.isNull(), "—").otherwise(F.format_string("%+.1fpp", delta * 100))


def epoch_text(seconds: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    return F.date_format(F.timestamp_seconds(seconds), pattern)
