"""Free-text requests: lexicon matching, negation, targets, and what is left over."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK, BEFORE, HIGH, LOW = "　", 4, 0.85, 0.15
#: Negations, filler words, particles and degree adverbs of Chinese requests.
NEGATIONS = ("不要", "别", "不想", "没有", "去掉", "不是")
FILLERS = ("来点", "来首", "来一支", "放点", "放首", "听点", "听首", "我想", "我要", "帮我", "推荐", "一些", "一点", "一首", "首歌", "的歌", "的音", "谢谢", "请", "的")
MARKS = ",，。.!！?？、〜~·…"
PARTICLES = ("的", "又", "而", "是")
DEGREES = ("很", "太", "非常", "超级", "超", "比较", "挺", "更", "最", "有点", "有些", "稍微", "特别", "不太", "略微")
TRAILERS = ("一点", "一些", "点儿", "一些些", "点")


def match_terms(text: str, terms: list[str]) -> list[tuple[int, str]]:
    """(position, term), each term at most once, longer terms first; matched text can't match again. By position in text."""
    rest, out = text, []
    for term in sorted(set(terms), key=lambda t: (-len(t), t)):
        if term and (at := rest.find(term)) >= 0:
            out.append((text.find(term), term))
            rest = rest[:at] + BLANK * len(term) + rest[at + len(term) :]
    return sorted(out)


def negated(text: str, at: int) -> bool:
    return at > 0 and any(n in text[max(0, at - BEFORE) : at] for n in NEGATIONS)


def parse(text: str, lexicon: dict[str, tuple[list[str], list[str]]], flags: dict[str, str] | None = None) -> dict:
    """Targets by dimension (first word of a dimension wins, negation turns it round), filters, and unmatched words."""
    high = {w: d for d, (up, _) in lexicon.items() for w in up}
    low = {w: d for d, (_, down) in lexicon.items() for w in down}
    flags = flags or {}
    found = match_terms(text, [*high, *low, *flags])
    query: dict[str, float] = {}
    filters, matched = {}, []
    for at, w in found:
        turn = negated(text, at)
        matched.append(w)
        if w in flags:
            filters[{"flagged": "unflagged", "unflagged": "flagged"}.get(flags[w], flags[w]) if turn else flags[w]] = True
        else:
            query.setdefault(high.get(w) or low[w], HIGH if (w in high) != turn else LOW)
    return {"query": query, "hard_filter": filters, "matched": matched, "unmatched": residue(text, matched)}


def residue(text: str, matched: list[str], known: tuple[str, ...] = ()) -> list[str]:
    """Words of two characters or more that nothing explains, each once: fillers, matched words and negations go, what is
    left is parted at particles and marks, and degree adverbs before and trailers behind a word go too."""
    gap = rf"[\s{re.escape(MARKS)}]*"
    text = re.sub(f"{gap}(?:{'|'.join(FILLERS)})+{gap}", " ", text)
    for w in [*sorted(matched, key=len, reverse=True), *NEGATIONS]:
        text = text.replace(w, " ")
    out: list[str] = []
    for part in re.split(rf"[\s{re.escape(MARKS)}/|{''.join(PARTICLES)}]+", text):
        part = re.sub(f"^(?:{'|'.join(DEGREES)})+|(?:{'|'.join(TRAILERS)})+$", "", part)
        if len(part) >= 2 and part not in out and part not in known:
            out.append(part)
    return out


def tag_request(text: str, languages: dict[str, str | None], genres: dict[str, tuple[str, dict]], registers: dict[str, tuple[str, dict]], tagged: dict[str, int], dims: set[str]) -> dict:
    """What language, genre and register words of a request ask for: query, hard_filter, matched, unmatched, proxies.

    tagged: how many rows of the library carry a language and a genre; dims: dimensions it has. A language word becomes a
    filter by tag (without a value: unflagged rows), or is unmatched if no row is tagged. A genre word becomes a filter if any
    row is tagged, else targets of the dimensions that usually go with it, marked as a proxy; a register word always the
    latter. Targets do not replace those there are; a word with no dimension of the library is unmatched.
    """
    query: dict[str, float] = {}
    hard, matched, unmatched, proxies = {}, [], [], []
    for term in (t for t in languages if t in text):
        if languages[term] is None:
            hard["unflagged"] = True
        elif tagged.get("language"):
            hard["language_is"] = languages[term]
        else:
            unmatched.append((term, "no-language-tag-in-library"))
            continue
        matched.append(term)
    for kind, words, reason in (("genre", genres, "no-genre-tag-in-library"), ("register", registers, "no-vocal-dimensions-in-library")):
        for term, (name, shape) in ((t, words[t]) for t in words if t in text):
            if kind == "genre" and tagged.get("genre"):
                hard["genre_is"] = name
                matched.append(term)
                continue
            used = {d: v for d, v in shape.items() if d in dims}
            if not used:
                unmatched.append((term, reason))
                continue
            for d, v in used.items():
                query.setdefault(d, v)
            proxies.append((kind, term, name, sorted(used)))
            matched.append(term)
    return {"query": query, "hard_filter": hard, "matched": matched, "unmatched": unmatched, "proxies": proxies}


def matches_column(text: Column, terms: list[str]) -> Column:
    """match_terms of a column of texts, joined by commas in order of position; JVM only, one fold over the terms."""
    ordered = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    acc = F.struct(text.alias("rest"), F.array().cast("array<struct<at:int,term:string>>").alias("out"))

    def step(s: Column, term: Column) -> Column:
        at = F.call_function("locate", term, s["rest"])
        blank = F.concat(F.substring(s["rest"], F.lit(1), at - 1), F.repeat(F.lit(BLANK), F.length(term)), F.substring(s["rest"], at + F.length(term), F.length(s["rest"])))
        hit = F.array(F.struct(F.call_function("locate", term, text).alias("at"), term.alias("term")))
        return F.struct(F.when(at > 0, blank).otherwise(s["rest"]).alias("rest"), F.when(at > 0, F.concat(s["out"], hit)).otherwise(s["out"]).alias("out"))

    got = F.aggregate(F.array(*map(F.lit, ordered)), acc, step, lambda s: s["out"])
    return F.array_join(F.transform(F.array_sort(got), lambda h: h["term"]), ",")


def negated_column(text: Column, word: str, negations: tuple[str, ...] = NEGATIONS) -> Column:
    at = F.locate(word, text)
    before = F.substring(text, F.greatest(F.lit(1), at - BEFORE), F.least(F.lit(BEFORE), at - 1))
    return (at > 1) & before.rlike("|".join(map(re.escape, negations)))
