"""The small labelled table of the personal-data field: cases outside the base patterns, and hard negatives.

Rows are ``(text, spans)``, spans as ``kind:start:end,...``; drawn from templates with a fixed seed, so the table is
the same everywhere. Positive cases: payment cards next to another card or number, masked cards, phones without a
plus, e-mails spaced around the @, IP addresses with bracketed dots. Negatives: years, number columns, long numbers
without a valid check digit, order and part numbers of a phone's form, prices, dates, ratings.
"""

from __future__ import annotations

import random

_FILL = ("see the notes of", "ramiar cióncira", "und der", "we met", "then", "el total", "it was", "about", "les", "said that")
_PHONE = ("call", "phone", "tel", "telephone", "mobile", "fax", "ring", "whatsapp", "cell")
_CARD = ("card", "visa", "mastercard", "amex", "credit card", "paid with")
_NUMBER = ("order", "invoice", "part no", "isbn", "page", "item", "ticket", "version", "serial", "sku", "ref", "id")
_SURE = ("(ddd) ddd-dddd", "ddd-ddd-dddd")
_UNSURE = ("ddd ddd dddd", "dddddddddd", "0dd dddddddd", "0dddd dddddd", "00dd ddd dddddd", "ddd.ddd.dddd")


def _digits(r: random.Random, form: str) -> str:
    first = iter([str(r.randrange(2, 10))] + [""])
    return "".join((next(first, "") or str(r.randrange(10))) if c == "d" else c for c in form)


def _card(r: random.Random, valid: bool = True) -> str:
    from casework.llm.pii import luhn
    form, lead = r.choice([("16", "456"), ("16", "456"), ("4-4-4-4", "456"), ("4-6-5", "3")])
    groups = [int(g) for g in form.split("-")]
    while True:
        s = r.choice(lead) + "".join(str(r.randrange(10)) for _ in range(sum(groups) - 1))
        if luhn(s) == valid:
            at = [sum(groups[:i]) for i in range(len(groups) + 1)]
            return r.choice(" -").join(s[a:b] for a, b in zip(at, at[1:]))


def rows(seed: int = 7, each: int = 45) -> list[tuple[str, str]]:
    from casework.llm.pii import base_spans, join
    r = random.Random(seed)
    out = []

    def put(*parts: str | tuple[str, int]) -> None:
        text, spans = r.choice(_FILL) + " ", []
        for p in parts:
            s, kind = p if isinstance(p, tuple) else (p, None)
            if kind is not None:
                spans.append((len(text), len(text) + len(s), kind))
            text += s
        text += r.choice((" ", ", ", ". ")) + r.choice(_FILL)
        base = [b for b in base_spans(text)[0] if not any(a < b[1] and b[0] < e for a, e, _ in spans)]
        out.append((text, join(spans + base)))

    for _ in range(each):
        number = lambda n: str(r.randrange(10 ** (n - 1), 10 ** n))
        cue = r.choice(_PHONE) + r.choice((" ", ": ", " me on ", " us at "))
        # positive
        put((_card(r), 2), " ", (_card(r), 2))
        put((_card(r), 2), " ", (_card(r), 2), " ", (_card(r), 2))
        put(str(r.randrange(1950, 2030)), " ", (_card(r), 2), " ", number(4))
        put(cue, (_digits(r, r.choice(_SURE)), 3))
        put((_digits(r, r.choice(_SURE)), 3))
        put(cue, (_digits(r, r.choice(_UNSURE)), 3))
        mask = r.choice(("*", "x", "X")) * 4
        sep = r.choice(" -")
        put(r.choice(_CARD), " ", (sep.join([r.choice((mask, number(4))), mask, mask, number(4)]), 2))
        put((f"{r.choice(('bo', 'ana.ruiz', 'j_k7', 'max'))} @ {r.choice(('mail.org', 'web-de.net', 'a.b.fr'))}", 0))
        put((r.choice(("[.]", "(.)")).join(str(r.randrange(256)) for _ in range(4)), 1))
        # negative
        put(" ".join(str(r.randrange(1900, 2030)) for _ in range(r.randrange(2, 9))))
        put(" ".join(number(4) for _ in range(r.randrange(5, 12))))
        put(" ".join(number(r.randrange(1, 8)) for _ in range(r.randrange(3, 12))))
        put(_card(r, valid=False), " ", _card(r, valid=False))
        put(r.choice("12789"), number(13), " ", r.choice("12789"), number(13))
        put(r.choice(_NUMBER), " ", _digits(r, r.choice(_SURE + _UNSURE)))
        put(r.choice(_NUMBER), " ", _digits(r, r.choice(_SURE + _UNSURE)), "-", number(2))
        put(_digits(r, r.choice(_UNSURE)))
        put(number(10), " ", number(11))
        put(f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}")
        put(f"{r.randrange(1, 29):02}-{r.randrange(1, 13):02}-{r.randrange(1950, 2030)} {r.randrange(24)}:{r.randrange(10, 60)}")
        put(f"{r.randrange(1, 40)} @ {r.randrange(1, 99)}.{number(2)} each")
        put(f"{r.choice(('***', '****', '*****', 'XXXX'))} {number(r.randrange(1, 5))}")
        put(cue, number(r.randrange(1, 5)))
        put(f"@{r.choice(('bo', 'news'))}{number(2)} {number(r.randrange(1, 8))}.{number(2)}")
        put(f"{r.randrange(1990, 2030)}-{r.randrange(1990, 2030)} {number(3)}-{number(3)} {number(3)},{number(3)},{number(3)}")
    return out
