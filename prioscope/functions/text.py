"""String column functions: cleaning, keyword counts with negation, pattern counts.

Word characters are letters, digits of any kind and the underscore. Java's own
``\\b`` depends on the JDK version, so every boundary here is spelled out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from prioscope.settings import NEGATIONS, NEGATION_WINDOW

WORD = r"[\p{L}\p{N}_]"
NO_WORD = r"[^\p{L}\p{N}_]"
BLANK = r"[\t-\r\x1c-\x20\x85\p{Z}]"
WORD_EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
BLANK_CHARACTERS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(c: Column) -> Column:
    """Remove every kind of white space at both ends, not only blanks."""
    return F.btrim(c, F.lit(BLANK_CHARACTERS))


def capitalize(c: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def normalise(c: Column) -> Column:
    """Drop markup tags, lower the case, trim, and squeeze white space.

    A blank that stands alone is left as it is: nearly all white space is that.
    """
    untagged = F.when(F.contains(c, F.lit("<")), F.regexp_replace(c, "<[^>]+>", " ")).otherwise(c)
    return F.btrim(F.regexp_replace(F.lower(untagged), f"{BLANK}(?:{BLANK}+|(?<! ))", " "))


def quote(literal: str) -> str:
    """Escape a literal for use inside a Java pattern."""
    return "".join(ch if ch.isalnum() or ch in " _" else "\\" + ch for ch in literal)


def _is_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def _bounded(keyword: str) -> str:
    """The keyword and its right-hand word boundary."""
    return quote(keyword) + (f"(?!{WORD})" if _is_word(keyword[-1]) else f"(?={WORD})")


def keyword_groups(keywords: list[str]) -> list[list[str]]:
    """Split a lexicon so that within a group at most one keyword can start at a position.

    An alternation reports one match per position. Keywords that begin with each
    other ("profile", "profile picture") must both be counted, so they go to
    different groups; so do keywords that start with a word and a non-word character.
    """
    groups: list[list[str]] = []
    for keyword in keywords:
        for group in groups:
            same_kind = _is_word(group[0][0]) == _is_word(keyword[0])
            if same_kind and not any(
                keyword.startswith(k) or k.startswith(keyword) for k in group
            ):
                group.append(keyword)
                break
        else:
            groups.append([keyword])
    return groups


def _start_pattern(group: list[str]) -> str:
    """Zero-width pattern that captures the keyword of the group which starts here.

    The cheap test of the first letter comes before the boundary test, and keywords are
    tried by first letter.
    """
    by_initial: dict[str, list[str]] = {}
    for keyword in group:
        by_initial.setdefault(keyword[0], []).append(keyword)
    options = "|".join(
        f"{quote(first)}(?:{'|'.join(_ending(k) for k in words)})" for first, words in by_initial.items()
    )
    initials = "".join(quote(first) for first in by_initial)
    left = f"(?<!{WORD})" if _is_word(group[0][0]) else f"(?<={WORD})"
    return f"(?=[{initials}]){left}(?=({options}))"


def _ending(keyword: str) -> str:
    return quote(keyword[1:]) + (f"(?!{WORD})" if _is_word(keyword[-1]) else f"(?={WORD})")


def _negated_before(negations: list[str], window: int) -> str:
    """Look-behind: a negation lies within the last ``window`` characters.

    The window is a slice, so a word cut by its left edge counts as a whole word.
    """
    options = []
    for word in negations:
        gap = window - len(word)
        options.append(f"(?<!{WORD}){_bounded(word)}[\\s\\S]{{0,{gap}}}")
        options.append(f"{_bounded(word)}[\\s\\S]{{{gap}}}")
    return f"(?<=(?:{'|'.join(options)}))"


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """Every whole-word hit as an array of keywords; overlapping keywords all count."""
    return _extract(text, [(g, _start_pattern(g)) for g in keyword_groups(keywords)])


def negated_hits(
    text: Column,
    keywords: list[str],
    negations: list[str] = NEGATIONS,
    window: int = NEGATION_WINDOW,
) -> Column:
    """The hits that follow a negation within the window.

    Null if no negation occurs in the text at all, which plain substring tests tell.
    """
    behind = _negated_before(negations, window)
    hits = _extract(text, [(g, _start_pattern(g) + behind) for g in keyword_groups(keywords)])
    shortest = [n for n in negations if not any(o != n and o in n for o in negations)]
    return F.when(_any([F.contains(text, F.lit(n)) for n in shortest]), hits)


def _extract(text: Column, patterns: list[tuple[list[str], str]]) -> Column:
    found = []
    for group, pattern in patterns:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        if len(group) < 4:
            present = _any([F.contains(text, F.lit(k)) for k in group])
            hits = F.when(present, hits).otherwise(F.array().cast("array<string>"))
        found.append(hits)
    return found[0] if len(found) == 1 else F.concat(*found)


def count_of(hits: Column, keywords: list[str]) -> Column:
    """How many entries of a hit array belong to a lexicon."""
    return F.size(F.filter(hits, lambda k: k.isin(keywords)))


def count_contained(text: Column, phrases: list[str]) -> Column:
    """Number of phrases that occur anywhere, inside words too."""
    return _total([F.contains(text, F.lit(p)).cast("int") for p in phrases])


def _spell_edges(pattern: str) -> str:
    """Write each ``\\b`` as the one-sided test that its neighbours call for."""
    pieces = pattern.split(r"\b")
    out = pieces[0]
    for i, piece in enumerate(pieces[1:]):
        before, after = pieces[i].rstrip(")?"), piece.lstrip("(")
        if after[:1].isalnum() and not before[-1:].isalnum():
            out += f"(?<!{WORD})"
        elif before[-1:].isalnum() and not after[:1].isalnum():
            out += f"(?!{WORD})"
        else:
            out += WORD_EDGE
        out += piece
    return out


def _leading_literals(pattern: str) -> list[str]:
    """Texts one of which every match of the pattern must begin with; empty if unknown."""
    bare = pattern.removeprefix(r"\b")
    options = re.match(r"\(([a-z|]+)\)(?![?*{])", bare)
    if options:
        return options.group(1).split("|")
    literal = ""
    for ch in bare:
        if not (ch.isalnum() or ch in " %"):
            literal = literal[:-1] if ch in "?*{" else literal
            break
        literal += ch
    return [literal] if literal else []


def count_present_patterns(text: Column, patterns: list[str]) -> Column:
    """Number of patterns that match somewhere. A plain substring test comes first."""
    tests = []
    for pattern in patterns:
        test = F.rlike(text, F.lit(_spell_edges(pattern)))
        literals = _leading_literals(pattern)
        if literals == [pattern]:
            test = F.contains(text, F.lit(pattern))
        elif literals:
            test = _any([F.contains(text, F.lit(start)) for start in literals]) & test
        tests.append(test.cast("int"))
    return _total(tests)


def count_capital_words(text: Column) -> Column:
    """Words of three or more capitals A-Z."""
    return F.regexp_count(text, F.lit(f"(?=[A-Z])(?<!{WORD})[A-Z]{{3,}}(?!{WORD})"))


def count_character(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def word_tokens(text: Column, shortest: int = 1) -> Column:
    """Lower-cased runs of word characters with at least ``shortest`` characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}{{{shortest},}}"), F.lit(0))


def plain_words(text: Column) -> Column:
    """A lower-cased text in which only ASCII characters stand between words; one that is not all ASCII has blanks there."""
    low = F.lower(text)
    return F.when(F.length(low) == F.octet_length(low), low).otherwise(F.regexp_replace(low, f"{NO_WORD}+", " "))


def word_ngrams(tokens: Column, longest: int) -> Column:
    """All 1..``longest`` grams of a token array, words joined by a blank."""
    grams = tokens
    size = F.size(tokens)
    run = tokens
    for n in range(2, longest + 1):
        head = F.slice(run, F.lit(1), F.greatest(size - (n - 1), F.lit(0)))
        tail = F.slice(tokens, F.lit(n), F.greatest(size - (n - 1), F.lit(0)))
        run = F.zip_with(head, tail, lambda a, b: F.concat_ws(" ", a, b))
        grams = F.concat(grams, run)
    return grams


def fixed_point(c: Column, decimals: int) -> Column:
    """Decimal text of a number; exact binary ties go to the even digit."""
    return F.call_function("format_number", c, F.lit("0." + "0" * decimals))


def percent(c: Column, decimals: int) -> Column:
    return F.concat(fixed_point(c * 100, decimals), F.lit("%"))


def _any(tests: list[Column]) -> Column:
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return found


def _total(columns: list[Column]) -> Column:
    if not columns:
        return F.lit(0)
    total = columns[0]
    for column in columns[1:]:
        total = total + column
    return total
