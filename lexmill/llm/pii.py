"""Personal data and secrets: candidate spans, scored by boosted trees, and redacted.

Generators of high recall propose spans, which may overlap: e-mail addresses, network
addresses (IPv4, IPv6, MAC), telephone and account numbers (every sequence of neighbouring
digit groups of a fitting length, and IBANs), long keys, and any value after the name of
a secret. Boosted trees score each span by its format and
its context. A span is selected whose score reaches the threshold of its kind, calibrated
on held-out examples; of overlapping ones, the better.
"""

from __future__ import annotations

import ipaddress
import math
import random
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._text import buffers, fresh, table
from lexmill.llm.quality import Forest, fit_forest

KINDS = ("email", "ip", "phone", "account", "secret")
#: Digit groups that a number may consist of, and digits it may have.
GROUPS, LEAST_DIGITS, MOST_DIGITS = 8, 7, 24
#: The trees and thresholds that train gives, as written by running this module.
MODEL = Path(__file__).with_name("pii_model.npz")

_EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]++@[\w-]++(?:\.[\w-]++)+")
_IP = re.compile(r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9]|\.[0-9])")
_IPV6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{2,}+(?:\.[0-9]{1,3}){0,3}")
_MAC = re.compile(r"(?<![\w:-])[0-9A-Fa-f]{2}(?:(?::[0-9A-Fa-f]{2}){5}|(?:-[0-9A-Fa-f]{2}){5})(?!\w|[:-]\w)")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NAMED = re.compile(r"(?:token|secret|passw\w*|passphrase|pass|pwd|key|credentials?|bearer|auth\w*)[\"']?[ \t]{0,3}[=:][ \t]{0,3}([\"']?)(\S+)", re.I)
_RUN = re.compile(r"[+(]{0,2}[0-9](?:[0-9 ().+-]*[0-9])?")
_GROUP = re.compile(r"[0-9]+")
_JWT = re.compile(r"(?<![\w-])eyJ[\w-]{8,}+(?:\.[\w-]+){1,2}", re.A)
_PASSPORT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{7,8}(?![A-Za-z0-9])")
_PREFIX = re.compile(r"gh[opsu]_|sk-|pk-|xox[abp]-|AKIA|ASIA|AIza|eyJ|glpat-")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}")
_ASSIGNED = re.compile(r"[=:] ?[\"']?$")
_NO_DIGIT, _NO_HEX = re.compile(r"[^0-9]+"), re.compile(r"[^0-9a-fA-F]+")
_CLUES = {
    "secret": re.compile(r"token|secret|passw|pwd|api.?key|key|credential|bearer|auth", re.I),
    "hash": re.compile(r"commit|sha\d*|md5|checksum|digest|hash|revision|uuid|etag", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobile|contact", re.I),
    "account": re.compile(r"card|account|acct|iban|visa|ssn|social|passport|payment", re.I),
    "plain": re.compile(r"version|release|section|article|page|isbn|order|invoice|item|id|year|no\.|nr", re.I),
}


def _is_ipv6(s: str) -> bool:
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return len(s) > 2


def _named(text: str) -> list[tuple[int, int]]:
    """Values after names of secrets; what ends in punctuation may end before any of it."""
    out, at = [], 0
    while m := _NAMED.search(text, at):
        start, value = m.start(2), m[2]
        at = start
        if m[1] and m[1] in value:
            value = value[: value.index(m[1])]
            out.append((start, start + len(value)))
        else:
            bare = len(value)
            while bare and not value[bare - 1].isalnum():
                bare -= 1
            out += [(start, start + n) for n in {*range(max(bare, 1), min(bare + 8, len(value)) + 1), len(value)}]
    return [x for x in out if x[0] < x[1]]


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every proposed span, in characters."""
    out: list[tuple[int, int, str]] = []
    if "@" in text:
        out += [(*m.span(), "email") for m in _EMAIL.finditer(text)]
    out += [(*m.span(), "ip") for m in _IP.finditer(text)]
    if ":" in text:
        for m in _IPV6.finditer(text):
            for found in (m.group(), m.group().rstrip(":"), m.group().split(".")[0], m.group().split(".")[0].rstrip(":")):
                if _is_ipv6(found):
                    out.append((m.start(), m.start() + len(found), "ip"))
                    break
    out += [(*m.span(), "ip") for m in _MAC.finditer(text)]
    for m in _IBAN.finditer(text):
        # Capitals that follow may not belong to it.
        ends = {m.end(), *(m.start() + i for i, c in enumerate(m.group()) if c in " -")}
        out += [(m.start(), e, "account") for e in sorted(ends) if sum(c.isalnum() for c in text[m.start() : e]) >= 15]
    for run in _RUN.finditer(text):
        if run.end() - run.start() < LEAST_DIGITS:
            continue
        groups = [(m.start() + run.start(), m.end() + run.start()) for m in _GROUP.finditer(run.group())]
        for i, (start, _) in enumerate(groups):
            digits = 0
            for j in range(i, min(i + GROUPS, len(groups))):
                if j > i and groups[j][0] - groups[j - 1][1] > 3:
                    break
                digits += groups[j][1] - groups[j][0]
                if digits > MOST_DIGITS:
                    break
                if digits >= LEAST_DIGITS:
                    begin = start
                    while begin > run.start() and text[begin - 1] in "+(":
                        begin -= 1
                    out.append((begin, groups[j][1], "phone"))
                    if digits >= 9:
                        out.append((begin, groups[j][1], "account"))
    out += [(*m.span(), "account") for m in _PASSPORT.finditer(text)]
    if "eyJ" in text:
        out += [(*m.span(), "secret") for m in _JWT.finditer(text)]
    for m in _SECRET.finditer(text):
        if any(c.isdigit() for c in m.group()) or _ASSIGNED.search(text, max(0, m.start() - 4), m.start()):
            out.append((*m.span(), "secret"))
    have = {x[:2] for x in out if x[2] == "secret"}
    out += [(*x, "secret") for x in dict.fromkeys(_named(text)) if x not in have]
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban(s: str) -> bool:
    s = "".join(c for c in s if c.isalnum())
    return s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


_DIGITS = frozenset("0123456789")


def describe(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context features of a span."""
    s = text[start:end]
    digits = _NO_DIGIT.sub("", s)
    n = len(s)
    letters = sum(c.isalpha() for c in s)
    counts = Counter(s)
    before, after = text[max(0, start - 24) : start], text[end : end + 12]
    left, right = text[start - 1 : start], text[end : end + 1]
    groups = [len(g) for g in _GROUP.findall(s)]
    octets = [int(g) for g in _GROUP.findall(s)[:4]] if kind == "ip" else []
    side = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c in "0123456789" else 4 if c in ".,;:!?" else 5 if c in "\"'" else 6
    return [
        *(float(kind == k) for k in KINDS),
        n, len(digits), letters, len(digits) / n, letters / n, sum(c.isupper() for c in s) / n,
        len(_NO_HEX.sub("", s)) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        len(groups), max(groups, default=0), min(groups, default=0), float(len(digits) > 11 and _luhn(digits)),
        float(s.startswith("+")), float("(" in s), s.count(" "), s.count("-"), s.count("."), s.count("@"), s.count(":"),
        float(s[:2].isalpha() and kind == "account" and _iban(s)), float(kind == "secret" and s.isalpha() and (s.islower() or s[1:].islower())),
        sum(not c.isalnum() for c in s) / n, float(s[-1].isalnum()), float(kind == "ip" and "::" in s),
        float(kind == "secret" and right in ("!", "$")), float(kind == "secret" and s[-1] in "!$"), float(kind == "secret" and bool(_PREFIX.match(s))), s.count("_"),
        float(bool(octets) and max(octets) <= 255), float(bool(octets) and octets[0] > 0),
        side(left), side(right), float(right == "." and after[1:2] in _DIGITS), float(left == "." and before[-2:-1] in _DIGITS),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before.rstrip(" ").endswith(("$", "#", "v", "€"))),
        float(bool(re.search(r"[0-9][ ().+-]*$", before))), float(bool(re.match(r"[ ().-]{0,2}[0-9]", after))),
        *(float(bool(p.search(before))) for p in _CLUES.values()),
    ]


def examples(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Made-up texts with personal data and with things that only look like it, and the true spans."""
    r = random.Random(seed)
    syllables = "an be ca de er fo ge hi in jo ka le me no or pa qu re st ti un ve wi xo ya zu th sh ing tion".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-") for _ in range(k))

    def iban() -> str:
        body = r.choice([num(16), num(18), num(20), "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4)) + num(14), num(14), num(11)])
        land = r.choice(["DE", "GB", "FR", "LU", "AT", "NL", "ES", "CH"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        full = f"{land}{check:02d}{body}"
        sep = r.choice(["", " ", " "])
        return sep.join(full[i : i + 4] for i in range(0, len(full), 4))

    def address() -> str:
        group = lambda: f"{r.randrange(1 << 16):x}"
        sep = r.choice(":-")
        return r.choice([
            ":".join(group() for _ in range(8)), f"2001:db8:{group()}::{group()}", f"fe80::{group()}:{group()}:{group()}:{group()}", f"2a0{num(1)}:{group()}:{group()}::{r.randint(1, 99)}",
            sep.join(hexa(2) for _ in range(6)), sep.join(hexa(2).upper() for _ in range(6)),
        ])

    def password() -> tuple[str, str]:
        name = r.choice(["password", "Password", "passwd", "pwd", "pass", "secret", "token", "db_password", "api_key"])
        plain_ = "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
        body = r.choice([
            "".join(r.choice(plain_ + "!@$.%*?_-") for _ in range(r.randint(7, 14))), "".join(r.choice(plain_) for _ in range(r.randint(7, 14))),
            word().capitalize() + num(r.randint(2, 4)) + r.choice(["", "!", "$", "?"]), f"{word()}{r.choice('.-_@!$')}{word()}{num(2)}", f"{word()[:2]}@{word()}.{word()}{num(1)}", word() + num(1), word() + word() + num(r.randint(1, 3)),
        ]) + r.choice(["", "", "!", "$"])
        body = r.choice(plain_) + body + ("" if any(c.isdigit() for c in body) else num(1))
        return name + r.choice([" = ", "=", ": ", ":"]) + r.choice(['"', "'", "", ""]), body

    def card() -> str:
        body = num(15)
        full = body + next(d for d in "0123456789" if _luhn(body + d)) if r.random() < 0.4 else body + num(1)
        sep = r.choice(["", "", "", " ", "-"])
        return sep.join(full[i : i + 4] for i in range(0, 16, 4))

    pairs = lambda k: " ".join(num(2) for _ in range(k))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(20, 99)} {num(2)} {num(4)} {num(4)}", f"+{r.randint(20, 99)} {num(3)} {num(6)}", f"+1-{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(11)}", f"0{num(2)} {num(4)} {num(4)}", f"+{r.randint(30, 49)} {num(1)} {pairs(4)}", f"0{num(1)} {pairs(4)}", f"0{num(3)} {num(6)}", f"1-8{num(2)}-{num(3)}-{num(4)}"])

    def local() -> tuple[str, str]:
        return r.choice(["call ", "tel ", "phone: ", "Tel. ", "mobile: ", "fax "]), r.choice([f"{num(3)}-{num(4)}", f"{num(3)} {num(4)}", f"{num(4)}-{num(4)}", num(7)])

    def number() -> tuple[str, str]:
        group = lambda k: " ".join(num(4) for _ in range(k))
        return r.choice([
            (r.choice(["ssn ", "SSN: ", "social security number ", "ssn="]), f"{num(3)}-{num(2)}-{num(4)}"), (r.choice(["passport ", "passport no. ", "Passport: "]), r.choice([num(9), f"{r.choice('ABCEGKLP')}{num(8)}", f"{r.choice('ABCEGKLP')}{num(7)}"])),
            (r.choice(["account ", "acct ", "account no. ", "card "]), r.choice([group(5), group(6), num(20), num(10), num(12), f"{num(8)}-{num(2)}"])),
        ])

    def secret() -> tuple[str, str]:
        name = r.choice(["token", "api_key", "apikey", "secret", "password", "auth_token", "access_key", "key", "bearer"])
        value = r.choice([hexa(40), hexa(32), mixed(r.randint(20, 44)), "sk-" + mixed(32), "AKIA" + mixed(16).upper(), hexa(64)])
        if r.random() < 0.15:
            return r.choice(["", "", "use ", "key "]), r.choice(["ghp_" + mixed(36).replace("-", "a"), "sk-" + mixed(40), "xoxb-" + num(11) + "-" + mixed(24), "AKIA" + mixed(16).upper().replace("-", "A").replace("_", "B"), f"eyJ{mixed(20)}.{mixed(30)}.{mixed(30)}", f"eyJ{mixed(17)}.{mixed(18)}", "glpat-" + mixed(20)]) + num(1)
        if not any(c.isdigit() for c in value):
            return name + r.choice([" = ", "=", ": ", ":"]) + r.choice(['"', "'", ""]), value
        return name + r.choice([" = ", "=", ": ", ":", " = ", " "]) + r.choice(['"', "'", "", '"']), value

    def plain() -> str:
        return r.choice([
            f"version {r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 30)}", f"release {num(1)}.{num(2)}.{num(1)}.{num(4)}", f"section {num(1)}.{num(1)}.{num(1)}.{num(1)}",
            f"{r.randint(1800, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1990, 2030)}-{r.randint(1990, 2030)}", f"order {num(8)}", f"invoice no. {num(7)}", f"item {num(9)}",
            f"0.{num(r.randint(7, 16))}", f"{num(3)},{num(3)},{num(3)}", f"{r.randint(1, 99)}.{num(8)}", f"commit {hexa(40)}", f"sha256: {hexa(64)}", f"md5 {hexa(32)}", f"checksum {hexa(40)}",
            f"isbn 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(4)} {num(2)} {num(3)}", f"page {num(3)}", f"{num(25)}", f"{word()}-{word()}-{word()}-{word()}-{num(2)}", f"id {num(8)}", f"{num(4)}-{num(2)}-{num(2)} {num(2)}:{num(2)}:{num(2)}",
            f"{r.randint(256, 999)}.{num(3)}.{num(3)}.{num(3)}", f"user@{word()}", f"@{word()}{num(2)}", f"{' '.join(num(r.randint(1, 3)) for _ in range(r.randint(3, 12)))}", f"uuid {hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}",
            f"{word()}_{word()}_{word()}_{word()}{num(1)}", f"${num(3)},{num(3)}.{num(2)}", f"+{num(2)}%",
            *(f"{r.choice(['key', 'token', 'password', 'secret', 'Key', 'auth', 'pass'])}{r.choice([': ', '= ', ' = ', ':'])}{r.choice([word(), word(), word().capitalize(), num(r.randint(1, 3)), 'true', 'none', 'the', 'required'])}" for _ in range(4)),
            f"{num(2)}:{num(2)}:{num(2)}", f"{word()}::{word()}",
            f"version {r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 30)}.{r.randint(0, 9)}", f"{num(3)}-{num(4)}", f"{num(3)}-{num(2)}-{num(4)}", f"pages {num(3)} {num(4)}", f"{r.choice('ABCDEFGH')}{num(7)}", num(20), f"order {num(3)}-{num(7)}-{num(7)}", f"{word()}_{word()}_{word()}_{num(3)}",
        ])

    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(r.randint(4, 9)):
            text += " ".join(word() for _ in range(r.randint(1, 8))) + r.choice([" ", " ", " ", ". ", "\n", ", ", ".\n", " | ", "### ", "%%% "])
            # Now and then two things stand side by side.
            for again in range(1 + (r.random() < 0.2)):
                text += " " * again
                kind = r.choice(("plain", "plain", "plain", *KINDS))
                lead, tail = "", ""
                if kind == "plain":
                    text += plain()
                else:
                    if kind == "email":
                        value = r.choice([f"{word()}.{num(2)}", word(), f"{word()}.{word()}", f"{word()}+{word()}", f"{word()}_{num(3)}", f"{word()},{word()}.{num(2)}".split(",")[1]]) + "@" + r.choice([f"{word()}.com", f"mail{num(1)}.example.com", f"{word()}.{word()}.org", f"{word()}-{word()}.de", f"{word()}.co.uk"])
                    elif kind == "ip":
                        value = ".".join(str(r.randint(1 if i == 0 else 0, 255)) for i in range(4))
                        value = address() if r.random() < 0.4 else value
                        lead = r.choice(["", "", "", "ip ", "address ", "host: "])
                    elif kind == "phone":
                        lead, value = local() if r.random() < 0.2 else (r.choice(["", "", "", "tel ", "phone: ", "call "]), phone())
                    elif kind == "account":
                        lead, value = number() if r.random() < 0.3 else (r.choice(["", "", "", "", "card ", "account: ", "IBAN "]), r.choice([card, card, iban])())
                    else:
                        lead, value = r.choice([secret, secret, password])()
                        tail = lead[-1:] if lead.endswith(("'", '"')) else ""
                    text += lead
                    spans.append((len(text), len(text) + len(value), kind))
                    text += value + tail
            text += r.choice([" ", " ", " ", " ", ". ", ", ", "\n", "### ", "&&& ", " | "])
        out.append((text, spans))
    return out


@dataclass
class Forests:
    """Trees for each kind of candidate, by the columns of describe that tell kinds."""

    by: list[Forest]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for k, forest in enumerate(self.by):
            rows = np.flatnonzero(x[:, k] > 0)
            if len(rows):
                out[rows] = forest.score(x[rows])
        return out


@dataclass
class PiiModel:
    forest: Forests
    thresholds: dict[str, float]


def _labelled(texts: list[tuple[str, list[tuple[int, int, str]]]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    x, y, kinds = [], [], []
    for text, spans in texts:
        true = set(spans)
        for c in candidates(text):
            x.append(describe(text, *c))
            y.append(float(c in true))
            kinds.append(c[2])
    return np.array(x, float), np.array(y), kinds


def train(count: int = 3000, seed: int = 11, precision: float = 0.97) -> PiiModel:
    """Trees fitted on count made-up texts, and thresholds calibrated on as many others.

    Each kind's threshold is the least score from which on the held-out candidates have
    the precision; where that is all of them, 0.05. A kind that never reaches it is off.
    """
    x, y, _ = _labelled(examples(count, seed))
    forest = Forests([fit_forest(x[x[:, k] > 0], y[x[:, k] > 0], trees=60, depth=4, least=2.0) for k in range(len(KINDS))])
    hx, hy, kinds = _labelled(examples(count, seed + 1))
    score, kinds = forest.score(hx), np.array(kinds)
    thresholds = {}
    for kind in KINDS:
        s, t = score[kinds == kind], hy[kinds == kind]
        order = np.argsort(-s)
        right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= precision)
        thresholds[kind] = max(float(s[order][good[-1]]), 0.05) if len(good) else 2.0
    return PiiModel(forest, thresholds)


def save(model: PiiModel, path: Path = MODEL) -> None:
    parts = {f"{name}_{k}": getattr(forest, name) for k, forest in enumerate(model.forest.by) for name in ("feature", "above", "leaf", "base")}
    np.savez_compressed(path, thresholds=np.array([model.thresholds[k] for k in KINDS]), **parts)


@lru_cache(2)
def load(path: Path = MODEL) -> PiiModel:
    """The model that save wrote."""
    with np.load(path) as parts:
        by = [Forest(parts[f"feature_{k}"], parts[f"above_{k}"], parts[f"leaf_{k}"], float(parts[f"base_{k}"])) for k in range(len(KINDS))]
        return PiiModel(Forests(by), dict(zip(KINDS, parts["thresholds"].tolist(), strict=True)))


def select(spans: list[tuple[int, int, str]], scores: np.ndarray, model: PiiModel) -> list[tuple[int, int, str, float]]:
    """Spans that reach their thresholds, in order; of overlapping ones the best, then the longest, then the first."""
    good = [(-float(s), a - b, a, b, k) for (a, b, k), s in zip(spans, scores, strict=True) if s >= model.thresholds[k]]
    taken: list[tuple[int, int, str, float]] = []
    starts: list[int] = []
    for s, _, a, b, k in sorted(good):
        i = bisect_right(starts, a)
        if (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b):
            continue
        starts.insert(i, a)
        taken.insert(i, (a, b, k, -s))
    return taken


def mask(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    out, at = [], 0
    for a, b, kind, _ in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())])
_TELLING = np.isin(np.arange(256), list(b"0123456789@=:-"))


def _redacted(texts: pa.Array, model: PiiModel) -> pa.Array:
    data, offsets = buffers(texts)
    hits = np.concatenate([[0], np.flatnonzero(_TELLING[data])]) if len(data) else np.zeros(1, np.int64)
    # Every generator needs a digit, an @, a colon, a hyphen or an assignment: texts without have no candidates.
    at = np.searchsorted(hits[1:], offsets)
    rows = np.flatnonzero(np.diff(at))
    spans, x, owners = [], [], []
    bodies = {}
    for r in rows.tolist():
        text = texts[r].as_py()
        found = candidates(text)
        if found:
            bodies[r] = text
            spans.append(found)
            owners.append(r)
            x += [describe(text, *c) for c in found]
    changed, chosen = np.zeros(len(texts), bool), {}
    if x:
        scores = model.forest.score(np.array(x, float))
        i = 0
        for r, found in zip(owners, spans, strict=True):
            picked = select(found, scores[i : i + len(found)], model)
            i += len(found)
            if picked:
                changed[r] = True
                chosen[r] = picked
    texts = texts.cast(pa.string())
    new = pc.replace_with_mask(texts, pa.array(changed), pa.array([mask(bodies[r], chosen[r]) for r in sorted(chosen)], pa.string())) if chosen else texts
    null = np.asarray(texts.is_null())
    lists = pa.array([[dict(zip(("start", "end", "kind", "score"), s, strict=True)) for s in chosen.get(r, ())] for r in range(len(texts))], pa.list_(_SPAN))
    return pa.StructArray.from_arrays([new, lists], ["text", "spans"], mask=pa.array(null))


def redacted(text: Column, model: PiiModel) -> Column:
    """struct<text, spans>: the text with selected spans replaced by their kind, and the spans; null for null."""

    @F.arrow_udf("struct<text:string,spans:array<struct<start:int,end:int,kind:string,score:double>>>")
    def run(texts: pa.Array) -> pa.Array:
        return _redacted(texts, model)

    return run.asNondeterministic()(text)


def redact(docs: DataFrame, model: PiiModel | None = None, text: str = "text") -> DataFrame:
    """docs with the text redacted and pii_spans (with underscores where docs has that name).

    Span positions are characters of the original text. A null text stays null with null
    spans, the empty one empty with none; equal texts are redacted alike; an empty table
    stays empty. Whole texts are searched, however long. Digits are ASCII ones. Without a
    model, the one that train gives is read from MODEL.
    """
    tmp, spans = fresh(docs, "redacted"), fresh(docs, "pii_spans")
    out = docs.withColumn(tmp, redacted(F.col(text), model or load()))
    return out.withColumn(text, F.col(f"{tmp}.text")).withColumn(spans, F.col(f"{tmp}.spans")).drop(tmp)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = redact(spark.read.parquet(table(sf_dir, "documents")).select("doc_id", "text"))
    return docs.select("doc_id", "text", F.size("pii_spans").alias("n_spans"), "pii_spans")


if __name__ == "__main__":
    save(train())
