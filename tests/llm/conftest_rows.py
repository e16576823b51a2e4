"""Rows for the tests: clean prose, copies, and the odd cases."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, k1 long, component_id long, label string"
WORDS = {
    "en": "the of and to in is that it was for on are with as they at be this from have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au".split(),
}


def prose(rnd, lang, n):
    out = []
    while len(out) < n:
        out.append(rnd.choice(WORDS[lang]) + rnd.choice(["", "", "er", "ing" if lang == "en" else "ung" if lang == "de" else "tion"]))
    return " ".join(out)


def rows(n=60, seed=1):
    """Clean prose in three languages, near copies, exact copies, and the odd cases."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        text = prose(rnd, lang, rnd.randrange(30, 120))
        out.append((i, text, lang))
    base = prose(rnd, "en", 200)
    for k in range(6):
        w = base.split()
        w[10 + 7 * k] = f"edit{k}"
        out.append((100 + k, " ".join(w), "en"))
    out += [(200 + k, base.upper() if k % 2 else base, "en") for k in range(4)]
    long = " ".join(prose(rnd, "fr", 50) for _ in range(400))
    out += [
        (300, None, "en"), (301, "", None), (302, "   \n\t ", "de"), (303, "one", "en"), (304, "zwei worte", "de"), (305, "!!! ??? 123", None), (306, long, "fr"),
        (307, long + " x", "fr"), (308, "x" * 200_000, None), (309, "日本語 text 😀 mixed\u0000\u001c", None), (None, "no id at all here", "en"), (310, None, None),
    ]
    out.append(out[0])  # a repeated row
    return out
