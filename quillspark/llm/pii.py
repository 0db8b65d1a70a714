"""Personal data: anchors found by Aho-Corasick, boundaries by local parsers (operator 3)."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

BASE = ("email", "ip", "card", "phone")
#: The method's own kinds, after the base kinds in the order of spans.
ADDED = ("login_url", "iban", "account", "secret")
KINDS = {k: i for i, k in enumerate((*BASE, *ADDED))}
#: Words that announce an account or document number, lower-case.
CUES = ("account no", "account number", "acct no", "acct.", "passport no", "passport number", "ssn", "social security number", "policy no", "policy number")

#: Words that announce a secret, lower-case; the value follows after a colon, an equals sign or quotes.
SECRET_CUES = ("token", "secret", "password", "passwd", "pwd", "passphrase", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "accesskey", "private key", "private_key", "auth key", "auth_key", "bearer", "passwort", "kennwort", "contraseña", "mot de passe")
#: What keys of known issuers begin with, lower-case, and their whole shape.
KEYS = {
    "akia": r"AKIA[0-9A-Z]{16}",
    "asia": r"ASIA[0-9A-Z]{16}",
    "aiza": r"AIza[0-9A-Za-z_-]{35}",
    "ghp_": r"ghp_[0-9A-Za-z]{36}",
    "gho_": r"gho_[0-9A-Za-z]{36}",
    "github_pat_": r"github_pat_[0-9A-Za-z_]{22,255}",
    "glpat-": r"glpat-[0-9A-Za-z_-]{20,}",
    "xoxb-": r"xoxb-[0-9A-Za-z-]{10,}",
    "xoxp-": r"xoxp-[0-9A-Za-z-]{10,}",
    "sk-": r"sk-[0-9A-Za-z_-]{20,}",
    "sk_live_": r"sk_live_[0-9A-Za-z]{16,}",
    "eyj": r"eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{5,}",
    "-----begin ": r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:[^-]{0,20000}-----END (?:[A-Z]+ )?PRIVATE KEY-----)?",
}
#: Characters that a secret after a cue has at least; shorter ones, or such of one class, are words.
LEAST_SECRET = 8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"://[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,15}$")
_IBAN = re.compile(r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SECRET = re.compile(r"""["'\]]{0,2}[ \t]{0,3}(?:=>|:=|[:=])[ \t]{0,3}(?:[Bb]earer[ \t]+)?["']?([^\s"'<>,;(){}\[\]]{8,4096})|[ \t]{1,3}["']([^\s"'<>]{8,4096})["']""")
_BEARER = re.compile(r"[ \t]{1,3}([0-9A-Za-z._~+/=-]{16,4096})")
_KEYS = {k: re.compile(rf"{v}(?![0-9A-Za-z])" if not k.startswith("-") else v) for k, v in KEYS.items()}
_NUMBER = re.compile(r"[ :#.]{0,4}([A-Z]{0,2}[0-9](?:[ -]?[0-9]){5,19})(?![0-9A-Za-z])")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def secret_like(value: str) -> bool:
    """Letters and digits together, or marks among them, as no word has."""
    value = value.rstrip(".!?:")
    return len(value) >= LEAST_SECRET and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def anchors():
    """Kinds of places to look at: at-signs, digits, plus signs before digits, schemes, identifier cues, keys' beginnings."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    a.add_word("://", ("url", 3))
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
        a.add_word(f"+{d}", ("phone", 2))
    for c in CUES:
        a.add_word(c, ("cue", len(c)))
    for c in SECRET_CUES:
        a.add_word(c, ("bearer" if c == "bearer" else "secret", len(c)))
    for c in KEYS:
        a.add_word(c, (f"key {c}", len(c)))
    a.make_automaton()
    return a


def find(text: str | None, automaton, lowered: str | None = None) -> list[tuple[int, str, int]]:
    """All spans of a text as (start, kind, end): code points, end exclusive, by start, then by kind as listed.

    Each base kind goes left to right without overlaps; a failed check drops the span, and the search goes on after it.
    The added kinds need a scheme with name and password, a valid IBAN checksum, a cue right before the number, a cue
    and a mark or quotes right before a value with letters and digits, or the shape of a known issuer's key; they touch no
    other span, but that a login URL or a secret may hold what looks like a base kind.
    """
    if not text:
        return []
    if lowered is None:
        lowered = text.encode().lower().decode()  # bytes: A-Z alone
    out: list[tuple[int, str, int]] = []
    more: list[tuple[int, str, int]] = []
    email_end = ip_end = card_end = phone_end = 0
    for last, (kind, size) in automaton.iter(lowered):
        at = last - size + 1
        if kind == "digit":
            if at < card_end and at < ip_end:
                continue
            if at >= ip_end:
                m = _IP.match(text, at)
                if m:
                    ip_end = m.end()
                    if all(len(x := g.lstrip("0")) <= 3 and int(x or "0") <= 255 for g in m.groups()):
                        out.append((at, "ip", m.end()))
                else:
                    ip_end = _DIGITS.match(text, at).end()
            if at >= card_end:
                m = _CARD.match(text, at)
                if m:
                    card_end = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, "card", m.end()))
                if at >= 2 and text[at - 2 : at].isalpha() and (m := _IBAN.match(text, at - 2)) and (at < 3 or not text[at - 3].isalnum()) and iban_ok(m[1]):
                    more.append((at - 2, "iban", m.end(1)))
        elif kind == "email":
            if at >= email_end:
                s = at
                while s > email_end and text[s - 1] in _LOCAL:
                    s -= 1
                if s < at and (m := _DOMAIN.match(text, at)):
                    out.append((s, "email", m.end()))
                    email_end = m.end()
        elif kind == "phone":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((at, "phone", m.end()))
        elif kind == "url":
            if (m := _LOGIN.match(text, at)) and (s := _SCHEME.search(text, max(0, at - 16), at)):
                more.append((s.start(), "login_url", m.end()))
        elif kind in ("secret", "bearer"):
            m = _SECRET.match(text, last + 1) or (_BEARER.match(text, last + 1) if kind == "bearer" else None)
            if m:
                group = next(g for g in range(1, (m.lastindex or 1) + 1) if m[g] is not None)
                if secret_like(m[group]):
                    value = m[group].rstrip(".!?:")
                    more.append((m.start(group), "secret", m.start(group) + len(value)))
        elif kind != "cue":
            if (at == 0 or not text[at - 1].isalnum()) and (m := _KEYS[kind[4:]].match(text, at)):
                more.append((at, "secret", m.end()))
        elif (at == 0 or not text[at - 1].isalnum()) and (m := _NUMBER.match(text, last + 1)):
            more.append((m.start(1), "account", m.end(1)))
    if more:
        base = _merged(out)
        no_mail = _merged([x for x in out if x[1] != "email"])
        end = 0
        for s, k, e in sorted(set(more), key=lambda x: (x[0], KINDS[x[1]], -x[2])):
            if s >= end and (k == "secret" or not _meets(no_mail if k == "login_url" else base, s, e)):
                out.append((s, k, e))
                end = e
    return sorted(out, key=lambda x: (x[0], KINDS[x[1]]))


def _merged(spans: list[tuple[int, str, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover."""
    starts, ends = [], []
    for s, _, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _meets(stretches: tuple[list[int], list[int]], s: int, e: int) -> bool:
    k = bisect_right(stretches[1], s)
    return k < len(stretches[0]) and stretches[0][k] < e


def listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def detect(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all of them), n_spans (their number).

    Null and empty texts have no spans. Every whole text is read; repeated rows give a row each; an empty table none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = anchors()
        for b in C.steps(batches, "text"):
            counts, sha, spans, total = {k: [] for k in BASE}, [], [], []
            for t in b.column(1).to_pylist():
                found = find(t, a)
                base = [x for x in found if x[1] in counts]
                for k in BASE:
                    counts[k].append(sum(x[1] == k for x in base))
                sha.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(found))
                total.append(len(found))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(total, pa.int64())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact_text(text: str | None, automaton) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the whole stretch goes once."""
    found = find(text, automaton)
    if not found:
        return text
    out, at = [], 0
    for s, k, e in found:
        if s >= at:
            out += text[at:s], f"<{k}>"
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs, with `text` redacted; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = anchors()
        for b in C.steps(batches, text):
            k = b.schema.get_field_index(text)
            yield b.set_column(k, text, pa.array([redact_text(t, a) for t in b.column(k).to_pylist()], pa.string()))

    return docs.select(*(F.col(f"`{c}`") for c in docs.columns)).mapInArrow(run, docs.schema)
