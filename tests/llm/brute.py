"""Plain-Python twins of the operators, for small inputs."""

from __future__ import annotations

import re

from finelens.llm import quality_rules as Q

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text: str | None, width: int = 2) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*[w[k:] for k in range(width)])) if len(w) >= width else frozenset([tuple(w)] if w else [])


def near_components(texts: dict[int, str | None], width: int = 2) -> dict[int, int]:
    """doc_id -> smallest doc_id reachable over pairs at Jaccard >= 0.8."""
    sets = {d: shingles(t, width) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in ids}


def quality(text: str | None) -> dict:
    t = text or ""
    words = WORD.findall(t)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count: dict = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    covered = {p for i, g in enumerate(grams) if count[g] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if x.strip(BLANKS)]
    solid = lambda s: sum(c not in BLANKS for c in s)

    def fails(line: str) -> bool:
        s = line.strip(BLANKS)
        low = s.lower()
        return bool(
            (not re.search(Q.END_MARKS, s) and len(WORD.findall(s)) < Q.MIN_LINE_WORDS)
            or sum(c in Q.SYMBOLS for c in s) > Q.MAX_SYMBOL_SHARE * len(s)
            or sum(c in "|»›·" for c in s) >= 2
            or (len(WORD.findall(s)) <= Q.MAX_NAVIGATION_WORDS and re.search(Q.NAVIGATION, low))
            or (len(WORD.findall(s)) <= Q.MAX_BOILERPLATE_WORDS and re.search(Q.BOILERPLATE, low))
        )

    good = [x for x in lines if not fails(x)]
    base = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    lost = solid(t) - sum(map(solid, good))
    return {
        "n_words": len(words),
        "word_chars": solid(t),
        "n_symbols": sum(c in Q.SYMBOLS for c in t),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": base,
        "kept": not base and lost <= Q.MAX_LOSS * solid(t),
        "clean_text": "\n".join(good),
    }
