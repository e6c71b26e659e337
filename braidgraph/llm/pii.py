"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and cue words of secrets. At
each anchor a deterministic parser of its kind expands to both sides and validates what it finds. For the base kinds (email,
ip, card, phone) the spans are those of a leftmost, non-overlapping regular expression search; further kinds (iban:
bank accounts with a right checksum, secret: values given to keys and tokens, login: names in URLs) add spans of their own.

Spans are code points, end exclusive. Defined results: null and empty texts have no spans; a null doc_id and repeated rows
are kept row by row; an empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidgraph.llm.common import map_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret", "login")
SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
#: Cue words of secrets, schemes whose URLs can name a user.
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "private_key")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_parts = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_run = re.compile(r"[0-9]+")
_chain = re.compile(r"[0-9](?:[ -]?[0-9])+")
_tail = re.compile(r"[ ().0-9-]*")
_iban = re.compile(r"[0-9]{2}(?: ?[0-9A-Z]){11,30}(?![0-9A-Za-z])")
_value = re.compile(r"""["']?\s{0,3}[=:]\s{0,3}["']?([A-Za-z0-9_/+.-]{16,})""")
_user = re.compile(r"[^\s/@\"'<>]+@")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in DIGITS:
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for word in CUES:
        for form in {word, word.upper(), word.capitalize()}:
            found.add_word(form, ("cue", len(form)))
    for word in SCHEMES:
        found.add_word(word, ("scheme", len(word)))
    found.make_automaton()
    return found


_anchors = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if place % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _checked_iban(text: str) -> bool:
    joined = text.replace(" ", "")
    return 15 <= len(joined) <= 34 and int("".join(str(int(c, 36)) for c in joined[4:] + joined[:4])) % 97 == 1


class Scan:
    """Spans of one text. `done` holds, for each kind, where its search goes on."""

    def __init__(self, text: str):
        self.text, self.spans, self.done = text, {k: [] for k in KINDS}, dict.fromkeys(KINDS, 0)
        for end, (kind, size) in _anchors.iter(text):
            getattr(self, kind)(end + 1 - size, end + 1)

    def _take(self, kind: str, start: int, end: int, valid: bool = True) -> None:
        self.done[kind] = end
        if valid:
            self.spans[kind].append((start, end))

    def at(self, at: int, after: int) -> None:
        start, floor, text = at, self.done["email"], self.text
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := _domain.match(text, after)):
            self._take("email", start, m.end())

    def digit(self, at: int, after: int) -> None:
        text, done = self.text, self.done
        if at >= done["ip"]:
            if m := _parts.match(text, at):
                self._take("ip", at, m.end(), all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.groups())))
            else:
                done["ip"] = _run.match(text, at).end()
        if at >= done["card"]:
            if m := _chain.match(text, at):
                digits = m.group().replace(" ", "").replace("-", "")
                self._take("card", at, m.end(), 13 <= len(digits) <= 19 and luhn(digits))
            else:
                done["card"] = after
        if at >= done["iban"] and at >= 2 and text[at - 2 : at].isascii() and text[at - 2 : at].isalpha() and text[at - 2 : at].isupper() and not (at > 2 and text[at - 3].isalnum()):
            if (m := _iban.match(text, at)) and _checked_iban(text[at - 2 : m.end()]):
                self._take("iban", at - 2, m.end())

    def plus(self, at: int, after: int) -> None:
        text = self.text
        if at < self.done["phone"] or text[after : after + 1] not in DIGITS:
            return
        end = _tail.match(text, after + 1).end()
        while end > after + 2 and text[end - 1] not in DIGITS:
            end -= 1
        if end > after + 2:
            self._take("phone", at, end, 9 <= sum(c in DIGITS for c in text[at:end]) <= 15)

    def cue(self, at: int, after: int) -> None:
        if at >= self.done["secret"] and (m := _value.match(self.text, after)):
            self._take("secret", m.start(1), m.end(1))

    def scheme(self, at: int, after: int) -> None:
        if at >= self.done["login"] and (m := _user.match(self.text, after)):
            self._take("login", after, m.end() - 1)

    def joined(self, kinds: tuple[str, ...]) -> str:
        return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in self.spans[k])


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """SPANS of every row of docs."""

    def run(batch):
        made = []
        for t in batch.column(1):
            scan = Scan(t.as_py() or "")
            base = scan.joined(BASE)
            made.append((*(len(scan.spans[k]) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), scan.joined(KINDS)))
        columns = zip(*made, strict=True) if made else [()] * 6
        return {"doc_id": batch.column(0)} | dict(zip(("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"), columns, strict=True))

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, SPANS)


def mask(text: str | None, fill: str = "<{}>") -> str | None:
    """A text with every span replaced by its kind; where spans overlap, the one that starts first (then the longer) counts."""
    if not text:
        return text
    spans = sorted(((a, -b, k) for k, found in Scan(text).spans.items() for a, b in found))
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], fill.format(kind)]
            at = -b
    return "".join([*out, text[at:]])
