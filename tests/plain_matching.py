"""A plain version of the folded matcher, character by character, for tests."""

import unicodedata

from lectern.functions.folding import SPACES
from lectern.operators.matching import CLOSING, LEAST, LEAST_TRIGRAMS, PREFIX_LEAST, PREFIX_SCORES, PREFIX_SHARE, SURE


def fold(char, form):
    out = unicodedata.normalize("NFKD", char).replace("\u00ad", "").lower()
    out = "".join(" " if c in SPACES or c in " \t\n\x0b\f\r" else c for c in out)
    return out if form == "light" else "".join(c if "a" <= c <= "z" or "0" <= c <= "9" else " " for c in out)


def folded(text, form):
    return ("" if form == "dense" else " ").join("".join(fold(c, form) for c in text).split(" ")).strip() if form == "dense" else " ".join(x for x in "".join(fold(c, form) for c in text).split(" ") if x)


def page(texts, form):
    """(text, rows of item, begin, end)"""
    chars, rows = [], []
    for number, text in enumerate(texts):
        blank = some = False
        for place, char in enumerate(text):
            for c in fold(char, form):
                if c == " ":
                    blank = some
                    continue
                if blank and form != "dense":
                    chars.append(" ")
                    rows.append((number, place, place + 1))
                chars.append(c)
                rows.append((number, place, place + 1))
                blank, some = False, True
        if form != "dense":
            chars.append(" ")
            rows.append((number, len(text), rows[-1][2] if some else len(text)))
    return "".join(chars), rows


def find_folded(needle, texts, threshold=0.55):
    quote = {form: folded(needle or "", form) for form in ("light", "heavy", "dense")}
    if not texts or len(quote["heavy"]) < LEAST:
        return None
    made = {form: page(texts, form) for form in quote}

    def span(form, b, e, score):
        rows = made[form][1]
        last, end = rows[e - 1][0], rows[e - 1][2]
        rest = texts[last][end:]
        return rows[b][0], rows[b][1], last, end + len(rest) - len(rest.lstrip(CLOSING)), score

    tries = [(form, quote[form], 1.0) for form in quote if len(quote[form]) >= LEAST]
    tries += [(form, quote[form][: max(PREFIX_LEAST, int(len(quote[form]) * PREFIX_SHARE))], score) for form, score in PREFIX_SCORES if score >= threshold]
    for form, part, score in tries:
        at = made[form][0].find(part)
        if at >= 0:
            return span(form, at, min(at + len(quote[form]), len(made[form][0])), score)
    text, q = made["heavy"][0], quote["heavy"]
    if len(q) < LEAST_TRIGRAMS or len(text) < len(q):
        return None
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    scores = [len(grams(text[i : i + len(q)]) & grams(q)) / len(grams(text[i : i + len(q)]) | grams(q)) for i in range(len(text) - len(q) + 1)]
    at = next((i for i, x in enumerate(scores) if x > SURE), scores.index(max(scores)))
    return span("heavy", at, at + len(q), scores[at]) if scores[at] > threshold - 0.001 else None
