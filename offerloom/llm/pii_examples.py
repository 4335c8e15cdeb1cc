"""Labelled examples of personal data and of what only looks like it.

Forms are drawn at random from a seed. Half of all examples stand in a context
that says what they are, the rest among neutral words, so that trees learn to go
by the format where that is enough and by the context where it isn't.
"""

from __future__ import annotations

import random

#: Forms of personal data by kind: N any digit, M one from 1 to 9, H a hex digit,
#: a a letter, W a word; D stands for a digit that makes the whole pass Luhn.
RIGHT = {
    "email": ["W.W [at] W [dot] com", "W(at)W.com", "WNN [at] W.org", "W at W dot com", "W.W at W dot co dot uk", "W {at} W.net", "W_W (at) W (dot) de", "Wé@W.fr", "Wö.W@W-W.de"],
    "ip": ["HHHH:HHHH:HHHH:HHHH:HHHH:HHHH:HHHH:HHHH", "MNNN:HHH::HHHH:H:HHH", "fe80:0:0:H:HHHH:HHHH:HHHH:HHHH", "HHHH:HHH:HHHH:HHHH::H"],
    "card": ["4NNN.NNNN.NNNN.NNND", "5NNN/NNNN/NNNN/NNND", "4NNN  NNNN  NNNN  NNND", "37NN.NNNNNN.NNNND"],
    "phone": ["+M (MNN) NNN-NNNN", "+MN NNN NNN NNN", "(MNN) NNN-NNNN", "(MNN)NNN-NNNN", "MNN-NNN-NNNN", "MNN.NNN.NNNN", "0NNN NNN NNN", "0NN NNNN NNNN", "0NNN/NNNNNN", "00MN NNN NNN NNN", "0N NN NN NN NN"],
    "account": ["DEXX NNNN NNNN NNNN NNNN NN", "FRXXNNNNNNNNNNNNNNNNNNNNNNN", "ESXX NNNN NNNN NNNN NNNN NNNN", "GBXX AAAA NNNN NNNN NNNN NN"],
    "national_id": ["MNN-NN-NNNN", "MNN NN NNNN"],
}
#: Forms that are none, though generators propose them, with the kinds they pass for.
WRONG = {
    "email": ["W (at) W.W", "W at W dot W W", "W@W.NN", "W [at] NN.NN"],
    "ip": ["M.N.N.NNNN", "NN.NN.NNNN.NN", "NN:NN:NN:NN", "M:NN:NN:NN", "HH:HH:HH:HH:HH:HH"],
    "card": ["MNNNNNNNNNNN", "MNNN-NNNN-NNNN-NNNN", "MNNN.NNNN.NNNN.NNNN", "97NNNNNNNNNNN", "20NN-NN-NN NN.NN", "MNN NNN NNN NNN"],
    "phone": ["MNNNNNNN", "20NN-NN-NN", "NN/NN/20NN", "MN NNN NNN", "M.NNN.NNN", "20NN-20NN", "NN.NN.20NN NN", "MNNN-NNNN", "97N-N-NNN-NNNNN-N", "MNNNNNNNNN", "MNN NNN NNN", "MNN-MNN", "N.NN.NNNNN"],
    "account": ["ABXX NNNN NNNN", "CCNN AAAA AAAA", "IDNNNNNNNNNN"],
    "national_id": ["MNN-NN-NN", "20NN NN NNNN", "NN-NN-20NN", "MNN NN NNN", "MNNNNNNNN", "20NN-NN-NNNN"],
}
CONTEXT = {
    "email": ["email: {}", "write to {}", "contact me: {}", "my mail is {} thanks"],
    "ip": ["server {} is down", "login from {}", "host {}", "client address {}"],
    "card": ["card number {}", "my visa {} expires", "payment by credit card: {}"],
    "phone": ["call me: {}", "tel. {}", "phone {} after six", "mobile: {}", "fax {}"],
    "account": ["iban {}", "bank transfer to {}", "account: {}"],
    "national_id": ["ssn {}", "social security number {}", "passport or national id: {}", "ssn: {}"],
}
AGAINST = ["order {}", "isbn {}", "version {}", "invoice #{}", "pages {}", "serial {}", "total {}", "build {}", "ref {}", "tracking id {}", "price ${}", "vol. {}", "{}%", "model {}", "part {}"]
BESIDE = ["4NNN NNNN NNNN NNND", "+M (MNN) NNN-NNNN", "(MNN) NNN-NNNN", "NN.NN.NNN.NN", "MNN-NN-NNNN", "NN", "MNNN"]
WORDS = "the of and river under garden morning letter paper small green stone window table north yellow thing about seven letters running carried house street winter market people often again music number light".split()


def _digit_for_luhn(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _checked(text: str) -> str:
    plain = text.replace(" ", "").replace("XX", "00")
    number = int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4]))
    return text.replace("XX", f"{98 - number % 97:02d}")


def _drawn(form: str, r: random.Random) -> str:
    out = []
    for c in form:
        if c == "D":
            c = _digit_for_luhn("".join(x for x in "".join(out) if x.isdigit()))
        elif c in "NMHWA":
            c = {"N": lambda: r.choice("0123456789"), "M": lambda: r.choice("123456789"), "H": lambda: r.choice("0123456789abcdef"), "A": lambda: r.choice("BCDFGHJKL"), "W": lambda: r.choice(WORDS)}[c]()
        out.append(c)
    return "".join(out)


def examples(n: int, seed: int) -> list[tuple[str, int, int, int, bool]]:
    """(text, start, kind, end, whether it is right) of ``n`` candidates."""
    kinds = list(RIGHT)
    r = random.Random(seed)
    rows = []
    while len(rows) < n:
        kind = r.randrange(len(kinds))
        name = kinds[kind]
        right = r.random() < 0.5
        form = r.choice((RIGHT if right else WRONG)[name])
        own = form
        if name == "account" and right:
            country, rest = form[:2], form[2:]
            own = _checked(country + "".join(_drawn(c, r) if c in "NA" else c for c in rest))
        elif name == "account":
            own = form[:2] + "".join(_drawn(c, r) if c in "NA" else r.choice("0123456789") if c == "X" else c for c in form[2:])
        else:
            own = _drawn(form, r)
        told = r.random() < 0.5
        if right and name in ("national_id", "phone") and form in ("MNN NN NNNN", "0NN NNNN NNNN", "0NNN NNN NNN"):
            told = True
        pattern = r.choice(CONTEXT[name] if right else AGAINST) if told else "{}"
        before = " ".join(r.choices(WORDS, k=r.randrange(1, 6)))
        behind = " ".join(r.choices(WORDS, k=r.randrange(1, 6)))
        head, tail = pattern.split("{}")
        # another number may stand right beside
        beside = lambda: _drawn(r.choice(BESIDE), r) if r.random() < 0.15 else ""
        if more := beside():
            head += more + " "
        if more := beside():
            tail = " " + more + tail
        lead = f"{before} {head}"
        rows.append((f"{lead}{own}{tail} {behind}", len(lead), kind, len(lead) + len(own), right))
    return rows
