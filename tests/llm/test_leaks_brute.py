"""Decontamination against a plain-Python version over random items and altered copies of them."""

from __future__ import annotations

import random
import string

from newsweave.llm import decontaminate as d

PLAIN = "the of river stone green light every path turned slowly toward open water while morning birds crossed wide silent fields".split()  # noqa: SIM905
NAMES = ["Anna", "Bruno", "Chen", "Dara", "Élodie", "Farid"]
NOT_UNITS = ("in", "a", "m", "s", "h", "l", "g")


def template(text: str | None) -> list[tuple[str, int]]:
    """(small word, slot) of a text."""
    out = []
    for raw in (text or "").split():
        word = raw.strip(string.punctuation)
        if not word:
            continue
        small = word.lower()
        letters, digits = any(c.isalpha() for c in word), any(c.isdigit() for c in word)
        if digits and not letters:
            slot = 1
        elif word[0].isupper() and any(c in string.ascii_lowercase for c in word):
            slot = 2
        else:
            slot = 3 if small in d.UNITS and small not in NOT_UNITS else 0
        out.append((small, slot))
    return out


def keys(words: list[tuple[str, int]], size: int) -> list[tuple[int, bool, tuple]]:
    """(place, exact, key) of all windows of a size."""
    out = []
    for at in range(len(words) - size + 1):
        window = words[at : at + size]
        out.append((at, True, tuple(w for w, _ in window)))
        if size >= d.SHORTEST and sum(s == 0 for _, s in window) >= d.LITERALS:
            out.append((at, False, tuple(s or w for w, s in window)))
    return out


def one_to_one(pairs: set) -> bool:
    return len({y for _, y in pairs}) == len(pairs)


def one_value(pairs: set) -> bool:
    return len({x for x, _ in pairs}) == len(pairs)


def verdict(matched: dict[int, set], held: int, clashed: bool) -> tuple[int, bool] | None:
    """Windows and verbatim from the slot pairs of each matched window, by all stretches."""
    own = [matched[k] for k in sorted(matched)]
    every = [(a, b) for a in range(len(own)) for b in range(a + 1, len(own) + 1)]
    if clashed:
        longest = lambda fits: max((b - a for a, b in every if fits(set().union(*own[a:b]))), default=0)
        n = longest(lambda pairs: one_value(pairs) and one_to_one(pairs))
        return (n, longest(lambda pairs: all(x == y for x, y in pairs)) >= d.CLASHED) if n >= d.CLASHED else None
    stretch = max((b - a for a, b in every if one_value(set().union(*own[a:b]))), default=0)
    equal = sum(all(x == y for x, y in p) for p in own)
    need = min(d.LEAST, held)
    if stretch == len(own):
        n, same = stretch, equal == stretch
    else:
        n, same = max(stretch, equal), equal >= need
    return (n, same) if need and n >= need else None


def brute(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    out = set()
    for item_id, item_text in items:
        item = template(item_text)
        size = min(d.WINDOW, len(item))
        if not size:
            continue
        of_item: dict = {}
        for at, exact, key in keys(item, size):
            of_item.setdefault((exact, key), []).append(at)
        of = len({at for ats in of_item.values() for at in ats})
        of_rich = len({at for (exact, _), ats in of_item.items() if not exact for at in ats})
        for doc_id, text in docs:
            words = template(text)
            diagonals: dict[int, tuple[dict, dict]] = {}
            for at, exact, key in keys(words, size):
                for item_at in of_item.get((exact, key), []):
                    every, rich = diagonals.setdefault(at - item_at, ({}, {}))
                    pairs = {(x, x if exact else y) for (x, slot), (y, _) in zip(item[item_at : item_at + size], words[at : at + size]) if slot}
                    every.setdefault(item_at, set()).update(pairs)
                    if not exact:
                        rich[item_at] = every[item_at]
            found = []
            for every, rich in diagonals.values():
                clashed = not one_to_one(set().union(*every.values()))
                both = [v for v in (verdict(every, of, clashed), verdict(rich, of_rich, clashed)) if v]
                if both:
                    found.append((max(n for n, _ in both), any(same for _, same in both)))
            if found:
                out.add((doc_id, item_id, max(n for n, _ in found), any(same for _, same in found)))
    return out


def passage(rng: random.Random, n: int) -> list[str]:
    kinds = (lambda: rng.choice(PLAIN), lambda: rng.choice(NAMES), lambda: str(rng.randint(2, 40)), lambda: rng.choice(["km", "hours", "grams"]))
    return [rng.choices(kinds, (80, 9, 8, 3))[0]() for _ in range(n)]


def altered(rng: random.Random, words: list[str]) -> list[str]:
    """A copy: whole, in part, with other names and numbers, or with some words replaced."""
    out, kind = list(words), rng.randrange(6)
    if kind == 1:
        out = out[: rng.randint(1, len(out))]
    elif kind == 2:
        other = dict(zip(NAMES, rng.sample(NAMES, len(NAMES))))
        shift = rng.randint(0, 3)
        out = [other.get(w, str(int(w) + shift) if w.isdigit() else w) for w in out]
    elif kind == 3:
        out[rng.randrange(len(out))] = rng.choice(NAMES + PLAIN)
    elif kind == 4:
        slots = [i for i, w in enumerate(out) if w in NAMES or w.isdigit()]
        for i in slots[-1:]:
            out[i] = rng.choice(NAMES) if out[i] in NAMES else "77"
    elif kind == 5:
        out = [w.upper() if w.isascii() else w for w in out]
    return [w + rng.choice(["", "", "", ",", "."]) for w in out]


def test_leaks_brute(spark):
    rng = random.Random(7)
    passages = [passage(rng, rng.choice([1, 3, 5, 7, 8, 9, 11, 16, 29, 40])) for _ in range(60)]
    items = [(i, " ".join(p)) for i, p in enumerate(passages)] + [(None, " ".join(passages[20])), (900, None), (901, ""), (902, "... -- !")]
    docs = [(1000, None), (1001, ""), (1002, "?")]
    for i in range(240):
        words = passage(rng, rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            words += altered(rng, rng.choice(passages)) + passage(rng, rng.randint(0, 12))
        docs.append((i if i else None, " ".join(words)))
    want = brute(docs, items)
    got = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {tuple(r) for r in got} == want
    assert len(got) == len(want)
    assert 100 < len(want) and {True, False} == {same for *_, same in want}


def test_planted_copies(spark):
    """Copies of a long item with one name changed, whatever other names the item has, are found as verbatim ones."""
    rng = random.Random(3)
    words = [rng.choice(PLAIN) for _ in range(98)]
    for at, name in ((4, "Anna"), (50, "Maria"), (80, "Bruno"), (85, "12")):
        words[at] = name
    changes = [{}, {"Anna": "Maria"}, {"Maria": "Anna"}, {"Anna": "Berta"}, {"Anna": "Maria", "Maria": "Anna"}, {"Bruno": "Maria", "12": "13"}, {"Anna": "Bruno", "Maria": "Bruno"}]
    docs = [(i, " ".join([*passage(rng, 20), *(change.get(w, w) for w in words), *passage(rng, 20)])) for i, change in enumerate(changes)]
    docs += [(100 + i, " ".join(passage(rng, 200))) for i in range(20)]
    got = {r.doc_id: (r.n_windows, r.verbatim) for r in d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()}
    assert set(got) == set(range(len(changes)))
    assert got[0] == (91, True)
    assert all(n >= 35 for n, _ in got.values())
    assert {i for i, (_, same) in got.items() if same} == {0, 1, 2, 5, 6}  # 3 and 4 map names one to one throughout
