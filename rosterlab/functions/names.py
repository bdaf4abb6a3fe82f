"""Name, team and game-text expressions; all native columns except the optional sequence scorer."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlab import constants as C


@lru_cache(maxsize=1)
def _accent_folds() -> tuple[str, str, dict[str, str]]:
    """Rule-built folds of all of Unicode: to one character for ``translate``, and to several."""
    source, target, several = [], [], {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        folded = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        plain = "".join(c for c in folded if c == " " or (c.isascii() and c.isalnum()))
        if folded == char or not plain:
            continue
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        else:
            several[char] = plain
    return "".join(source), "".join(target), several


def fold_accents(name: Column) -> Column:
    """Compatibility-fold accented characters to their base letters; plain ASCII values are not touched."""
    source, target, several = _accent_folds()
    folded = F.translate(name, source, target)
    folded = F.regexp_replace(folded, r"\p{M}", "")
    pairs = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(folded, ""), lambda c: F.coalesce(F.try_element_at(pairs, c), c)), "")
    folded = F.when(folded.rlike(f"[{re.escape(''.join(several))}]"), spelled).otherwise(folded)
    return F.when(name.rlike(r"[^\x00-\x7F]"), folded).otherwise(name)


def name_key(name: Column) -> Column:
    """Match key: accents folded, punctuation and suffix words removed, lower case, single spaces."""
    letters = F.lower(F.regexp_replace(fold_accents(name), r"[^A-Za-z0-9 ]", ""))
    without_suffix = F.regexp_replace(letters, r"\b(" + "|".join(C.NAME_SUFFIX_WORDS) + r")\b", "")
    return F.trim(F.regexp_replace(without_suffix, r" +", " "))


def canon_team(team: Column) -> Column:
    """Trimmed upper-case team code with alternative spellings mapped to one code."""
    code = F.upper(F.trim(team))
    pairs = [F.lit(x) for pair in C.TEAM_ALIASES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def is_defense(name: Column) -> Column:
    """True when any word of the name (letters only) is a team-defense word."""
    words = F.split(F.lower(F.regexp_replace(name, r"[^A-Za-z ]", "")), r" +")
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in C.DEFENSE_WORDS]))


_TEAM_PAIR = r"\b([A-Z]{2,3})\s*@\s*([A-Z]{2,3})\b"
_GAME_DATE = r"(\d{2}/\d{2}/\d{4})"


def game_away(game: Column) -> Column:
    return F.nullif(F.regexp_extract(game, _TEAM_PAIR, 1), F.lit(""))


def game_home(game: Column) -> Column:
    return F.nullif(F.regexp_extract(game, _TEAM_PAIR, 2), F.lit(""))


def game_date(game: Column) -> Column:
    """Date in the game text; null when it is invalid or when there is no team pair."""
    text = F.nullif(F.regexp_extract(game, _GAME_DATE, 1), F.lit(""))
    return F.when(game_away(game).isNotNull(), F.try_to_date(text, "MM/dd/yyyy"))


def derive_opponent(opponent: Column, team: Column, away: Column, home: Column) -> Column:
    """Stated opponent, else the other side of the game, else null."""
    other_side = F.when(team == away, home).when(team == home, away)
    return F.coalesce(F.nullif(F.trim(opponent), F.lit("")), other_side)


def is_home(team: Column, home: Column) -> Column:
    return team == home


def pick_position(position: Column, roster_position: Column) -> Column:
    """Position when present, else the first token of the roster position."""
    return F.coalesce(F.upper(F.trim(position)), F.upper(F.trim(F.split(roster_position, "/")[0])))


def canon_position(position: Column) -> Column:
    """Upper-case first token with the defense spellings mapped to DST."""
    token = F.trim(F.split(F.upper(F.trim(position)), "/")[0])
    return F.when(token.isin("DEF", "D", "D/ST"), F.lit("DST")).otherwise(token)


def split_name(name: Column) -> tuple[Column, Column]:
    """(first token, rest); a single token keeps the whole text as first name and an empty rest."""
    words = F.split(F.trim(name), r"\s+")
    several = F.size(words) >= 2
    rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.when(several, words[0]).otherwise(name), F.when(several, rest).otherwise(F.when(name.isNotNull(), F.lit("")))


def abbrev_alias(first: Column, last: Column) -> Column:
    """``F.Last`` when both parts exist, else null."""
    complete = (F.length(first) > 0) & (F.length(last) > 0)
    return F.when(complete, F.concat(F.left(first, F.lit(1)), F.lit("."), last))


def similarity_text(name: Column) -> Column:
    return F.replace(F.replace(F.lower(name), F.lit("."), F.lit("")), F.lit(" "), F.lit(""))


def _boosted(a: Column, b: Column, ratio: Column) -> Column:
    boost = F.when(a.contains(b) | b.contains(a), F.lit(0.2)).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(ratio + boost, F.lit(1.0)))


def text_similarity(a: Column, b: Column) -> Column:
    """Edit-distance ratio of two prepared texts, +0.2 when one contains the other, capped at 1."""
    return _boosted(a, b, 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def length_bound(similarity: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    """The highest score that two prepared texts of these lengths can have; 1 for a score it does not know."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    if similarity is text_similarity:
        return F.coalesce(shorter / longer, F.lit(1.0)) + 0.2
    if similarity is text_sequence_similarity:
        return F.coalesce(2 * shorter / (shorter + longer), F.lit(1.0)) + 0.2
    return F.lit(1.0)


def name_similarity(left: Column, right: Column) -> Column:
    return text_similarity(similarity_text(left), similarity_text(right))


def _sequence_ratio(left: Column, right: Column) -> Column:
    # Nested, so it is shipped by value and the workers need not have this package on their path.
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = zip(a, b, strict=True)
        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in pairs], dtype="float64")

    return F.pandas_udf(ratio, T.DoubleType())(left, right)


def text_sequence_similarity(a: Column, b: Column) -> Column:
    """The same score over the longest-matching-block ratio; Arrow batches, use it after blocking."""
    return _boosted(a, b, _sequence_ratio(a, b))


def sequence_similarity(left: Column, right: Column) -> Column:
    return text_sequence_similarity(similarity_text(left), similarity_text(right))


def name_traits(name: Column) -> dict[str, Column]:
    """Flags used by the identifier audit."""

    def has_any(texts: tuple[str, ...]) -> Column:
        flag = F.lit(False)
        for text in texts:
            flag = flag | name.contains(text)
        return flag

    return {
        "has_suffix": has_any(C.DISPLAY_SUFFIXES),
        "has_special": has_any(C.SPECIAL_NAME_CHARACTERS),
        "trailing_space": name != F.rtrim(name),
    }
