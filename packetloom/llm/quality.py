"""Line-first cleaning of documents, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import without

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
OWN = (*BASE, "kept", "n_lines", "n_bad_lines", "lost_chars", "line_chars", "clean_text")
#: Phrases of consent banners, legal notices and placeholders, in lower case.
BOILERPLATE = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "uses cookies", "enable javascript", "javascript is disabled", "lorem ipsum", "click here", "sign up for our newsletter", "skip to content")

#: Drops the six blanks from a text.
_BARE = r"translate({}, ' \t\n\u000b\u000c\r', '')"


#: Symbols of the punctuation rule and marks of the navigation rule, as SQL text.
_SYMBOLS, _BARS = r"'#*$%&|<>!^~=\\{}'", "'|>»•'"


def _count(text: str, marks: str) -> str:
    return f"(char_length({text}) - char_length(translate({text}, {marks}, '')))"


def _phrases(lowered: str) -> str:
    return "(" + " or ".join(f"contains({lowered}, '{p}')" for p in BOILERPLATE) + ")"


def line_fails(line: str = "x", *, symbol_percent: int = 10, shout_percent: int = 60, pipes: int = 3, has_symbols: str = "true", has_bars: str = "true", has_phrases: str = "true") -> str:
    """SQL for a line that breaks a rule; `line` is an SQL name.

    The last three are SQL conditions of the whole text without which no line can break
    the rule, so that most lines of most texts are not looked at for it.

    Punctuation: symbols and exclamation marks are over `symbol_percent` of the characters,
    or over `shout_percent` of at least 20 letters are capitals. Navigation: at least
    `pipes` bars, arrows or bullets, one for every three words or more. Boilerplate: one of
    the phrases in BOILERPLATE.
    """
    bare = _BARE.format(line)
    capitals = f"(char_length({line}) - char_length(regexp_replace({line}, '\\\\p{{Lu}}', '')))"
    letters = f"(char_length({line}) - char_length(regexp_replace({line}, '\\\\p{{L}}', '')))"
    bars = _count(line, _BARS)
    blanks = f"(char_length({line}) - char_length({bare}))"
    # Over half of a line's letters can only be capitals if two capitals follow one another.
    shouts = f"{line} rlike '\\\\p{{Lu}}\\\\P{{L}}*+\\\\p{{Lu}}'" if shout_percent >= 50 else "true"
    return f"(({has_symbols} and 100 * {_count(line, _SYMBOLS)} > {symbol_percent} * char_length({bare})) or ({has_bars} and {bars} >= {pipes} and 3 * {bars} >= {blanks} + 1) or ({shouts} and {letters} >= 20 and 100 * {capitals} > {shout_percent} * {letters}) or ({has_phrases} and {_phrases(f'lower({line})')}))"


def clean_lines(docs: DataFrame, *, text: str = "text", min_words: int = 50, repeat_percent: int = 50, lost_percent: int = 40) -> DataFrame:
    """Evaluates rules line by line, removes failing lines, then judges the document.

    Adds the base measures (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words),
    base_failed (under `min_words` words, or over `repeat_percent` of them in repeated
    three-word windows), n_lines and n_bad_lines (lines with a word; of these, those that
    fail), line_chars and lost_chars (their characters other than blanks), clean_text (the
    lines that pass, in order) and kept: not base_failed, and at most `lost_percent` of the
    characters lost. Repeated windows are found by sorting their 64-bit hashes inside the
    row, in n log n steps, so nothing is shuffled. A null text counts as empty and gives a
    null clean_text; an empty one has no words and is base_failed; equal rows get equal
    results; input columns with the names above are replaced.
    """
    docs = without(docs, *OWN)
    # Input columns go by their place, so that none can clash with the names of the steps.
    names = [F.col(f"in{k}").alias(c) for k, c in enumerate(docs.columns)]
    raw = f"in{docs.columns.index(text)}"
    docs = docs.toDF(*[f"in{k}" for k in range(len(names))])
    t = "t__"
    step = docs.select("*", F.coalesce(F.col(raw), F.lit("")).alias(t))
    step = step.selectExpr("*", f"array_remove(split({t}, '[ \\\\t-\\\\r]+'), '') AS w__", f"filter(split({t}, '\\n'), x -> {_BARE.format('x')} <> '') AS l__")
    step = step.selectExpr("*", "size(w__) AS n__", "transform(slice(w__, 1, greatest(size(w__) - 2, 0)), (x, i) -> xxhash64(x, get(w__, i + 1), get(w__, i + 2))) AS h__")
    step = step.withColumn("d__", F.expr("size(array_distinct(h__)) < size(h__)"))
    step = step.withColumn("p__", F.expr("CASE WHEN d__ THEN sort_array(transform(h__, (x, i) -> named_struct('h', x, 'i', i))) END"))
    step = step.withColumn("f__", F.expr("sort_array(transform(filter(p__, (x, i) -> x.h = get(p__, i + 1).h or x.h = get(p__, i - 1).h), x -> x.i))"))
    step = step.withColumn("n_repeat_words", F.expr("CASE WHEN d__ THEN cast(aggregate(transform(f__, (x, i) -> least(3, coalesce(get(f__, i + 1) - x, 3))), 0, (a, x) -> a + x) AS long) ELSE 0L END"))
    # Lambda variables hold what is asked of the whole text, so that no line evaluates it anew.
    flags = f"transform(array(lower({t})), y -> named_struct('s', {_count(t, _SYMBOLS)} > 0, 'v', {_count(t, _BARS)} > 0, 'b', {_phrases('y')}))"
    step = step.withColumn("g__", F.expr(f"transform({flags}, f -> filter(l__, x -> not {line_fails(has_symbols='f.s', has_bars='f.v', has_phrases='f.b')}))[0]"))
    chars = "cast(aggregate({}, 0, (a, x) -> a + char_length(" + _BARE.format("x") + ")) AS long)"
    step = step.selectExpr(
        "*", "cast(n__ AS long) AS n_words", f"cast(char_length({_BARE.format(t)}) AS long) AS word_chars", f"cast(char_length({t}) - char_length(translate({t}, '#*$%&|<>', '')) AS long) AS n_symbols",
        "cast(size(l__) - size(array_distinct(l__)) AS long) AS n_dup_lines", "cast(size(l__) AS long) AS n_lines", "cast(size(l__) - size(g__) AS long) AS n_bad_lines", f"CASE WHEN size(g__) = size(l__) THEN cast(char_length({_BARE.format(t)}) AS long) ELSE {chars.format('g__')} END AS good__",
    )
    step = step.selectExpr("*", f"(n_words < {min_words} or 100 * n_repeat_words > {repeat_percent} * n_words) AS base_failed", "word_chars AS line_chars", "word_chars - good__ AS lost_chars")
    step = step.selectExpr("*", f"(not base_failed and 100 * lost_chars <= {lost_percent} * line_chars) AS kept", f"CASE WHEN {raw} IS NOT NULL THEN array_join(g__, '\\n') END AS clean_text")
    # A generator's columns keep a later filter from being pushed below and evaluated anew.
    return step.select(*names, F.inline(F.array(F.struct(*OWN))))


def quality_sql(documents: str = "documents", columns: str = "doc_id, {own}", where: str = "true") -> str:
    """The same in DuckDB's SQL."""
    bare = r"translate({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"
    length = "length({})"

    def count(line: str, chars: str) -> str:
        return f"(length({line}) - length(translate({line}, '{chars}', '')))"

    def regex(line: str, cls: str) -> str:
        return f"(length({line}) - length(regexp_replace({line}, '{cls}', '', 'g')))"

    phrases = " or ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)
    bars, b = count("x", "|>»•"), bare.format("x")
    fails = f"(100 * {count('x', '#*$%&|<>!^~=' + chr(92) + '{}')} > 10 * length({b}) or ({bars} >= 3 and 3 * {bars} >= length(x) - length({b}) + 1) or ({regex('x', chr(92) + 'p{L}')} >= 20 and 100 * {regex('x', chr(92) + 'p{Lu}')} > 60 * {regex('x', chr(92) + 'p{L}')}) or {phrases})"
    own = "n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 100 * (word_chars - good) <= 40 * word_chars AS kept, n_lines, n_lines - n_good AS n_bad_lines, word_chars - good AS lost_chars"
    return f"""
    WITH src AS (SELECT *, coalesce(text, '') AS t FROM {documents}),
    base AS (SELECT *, list_filter(string_split_regex(t, '[ \\t-\\r]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: {bare.format('x')} <> '') AS l FROM src),
    win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda j: w[j] || ' ' || w[j + 1] || ' ' || w[j + 2])) AS g FROM base WHERE len(w) >= 3),
    rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c >= 2),
    cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
    good AS (SELECT *, list_filter(l, lambda x: not {fails}) AS g FROM base),
    m AS (SELECT good.*, cast(len(w) AS BIGINT) AS n_words, cast(length({bare.format('t')}) AS BIGINT) AS word_chars, cast({count('t', '#*$%&|<>')} AS BIGINT) AS n_symbols,
      cast(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, cast(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, cast(len(l) AS BIGINT) AS n_lines, cast(len(g) AS BIGINT) AS n_good,
      cast(coalesce(list_sum(list_transform(g, lambda x: {length.format(b)})), 0) AS BIGINT) AS good FROM good LEFT JOIN cov USING (doc_id)),
    judged AS (SELECT *, n_words < 50 or 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT {columns.format(own=own)} FROM judged WHERE {where}"""
