"""Personal data found by anchors: an Aho-Corasick pass marks places, small deterministic parsers expand each.

Anchors are at-signs (email), plus signs (phone), digits (ip, card), address schemes (url), identifier cues
(account), and cues and starts of credentials (secret). A parser walks out from its anchor to the span's bounds, then validates; nothing is matched away from an
anchor. The four base kinds give exactly the leftmost non-overlapping matches of their patterns:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
    card   [0-9]([\\x20-]?[0-9])+, 16 to 19 digits that pass the Luhn check
    phone  \\+[0-9][\\x20().0-9-]+[0-9], 8 to 15 digits

and three kinds are added: url (an address that carries user information), account (an identifier after a cue,
or an IBAN whose check digits hold) and secret (the value set after a cue such as "password", or a key by its well-known start). Offsets count code points, ends are exclusive.

Defined results: a null text counts as empty and has no spans; a failed check drops a match without a second try;
long texts are scanned whole, each character a bounded number of times per kind; repeated rows each get a row; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = frozenset(string.digits)
LABEL = frozenset(string.ascii_letters + string.digits + "-")
LOCAL = LABEL | frozenset("._%+")
PHONE = DIGITS | frozenset(" ().-")
ALNUM = frozenset(string.ascii_letters + string.digits)
URL_END = frozenset(' \t\n\r\x0b\x0c"<>`{}|\\^')
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")
CUES = ("account", "acct", "iban", "ssn", "passport")
SECRET_CUES = ("password", "passwd", "pwd", "secret", "token", "key")
KEY_STARTS = {"AKIA": 16, "ASIA": 16, "ghp_": 36, "gho_": 36, "github_pat_": 22, "xoxb-": 20, "xoxp-": 20}  # letters and digits that follow, at least
SECRET = ALNUM | frozenset("_-./+")
KEY = ALNUM | frozenset("_-")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for c in DIGITS:
        out.add_word(c, ("digit", 1))
    out.add_word("@", ("at", 1))
    out.add_word("+", ("plus", 1))
    for words, kind in ((SCHEMES, "url"), (CUES, "account"), (SECRET_CUES, "secret")):
        for w in words:
            for form in {w, w.upper(), w.capitalize()}:
                out.add_word(form, (kind, len(w)))
    for start in KEY_STARTS:
        out.add_word(start, ("key", len(start)))
    out.make_automaton()
    return out


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start, n = at, len(text)
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = at + 1
    while end < n and text[end] in LABEL:
        end += 1
    if start == at or end == at + 1:
        return None
    labels = 0
    while end + 1 < n and text[end] == "." and text[end + 1] in LABEL:
        end += 2
        while end < n and text[end] in LABEL:
            end += 1
        labels += 1
    return (start, end) if labels else None


def ip_at(text: str, at: int) -> tuple[int, bool]:
    """Where the scan goes on, and whether what it passed is an address that holds."""
    n, end, parts = len(text), at, []
    while True:
        start = end
        while end < n and text[end] in DIGITS:
            end += 1
        parts.append(text[start:end].lstrip("0"))
        if len(parts) == 4:
            return end, all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
        if end + 1 < n and text[end] == "." and text[end + 1] in DIGITS:
            end += 1
        else:
            return end, False


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def card_at(text: str, at: int) -> tuple[int, bool]:
    n, end = len(text), at + 1
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    digits = text[at:end].replace(" ", "").replace("-", "")
    return end, 16 <= len(digits) <= 19 and luhn(digits)


def phone_at(text: str, at: int) -> tuple[int, bool] | None:
    n = len(text)
    if at + 1 >= n or text[at + 1] not in DIGITS:
        return None
    end = at + 2
    while end < n and text[end] in PHONE:
        end += 1
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3:
        return None
    return end, 8 <= sum(c in DIGITS for c in text[at:end]) <= 15


def url_at(text: str, start: int, after: int) -> tuple[int, bool]:
    """An address to its end; it counts if it names a user: mailto, or user information before its host."""
    end, n = after, len(text)
    while end < n and text[end] not in URL_END:
        end += 1
    while end > after and text[end - 1] in ".,;:!?)]'":
        end -= 1
    authority = text[after:end].split("/", 1)[0]
    return end, 0 < authority.find("@") < len(authority) - 1


def iban(code: str) -> bool:
    if not (15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def account_at(text: str, after: int) -> tuple[int, int] | None:
    """The identifier that follows a cue within a few separators: an IBAN, or 6 to 20 letters and digits with 6 digits."""
    n, start = len(text), after
    while start < n and start - after < 4 and text[start] in " :#=.-":
        start += 1
    if start == after or start >= n or text[start] not in ALNUM:
        return None
    end = start
    while end < n and (text[end] in ALNUM or text[end] in " -" and end + 1 < n and text[end + 1] in ALNUM and end - start < 42):
        end += 1
    while end > start:  # whole groups from the right until what is left is an identifier
        code = text[start:end].replace(" ", "").replace("-", "")
        digits = sum(c in DIGITS for c in code)
        if iban(code.upper()) or (" " not in text[start:end] and 6 <= len(code) <= 20 and digits >= 6):
            return start, end
        end = max(text.rfind(" ", start, end), text.rfind("-", start, end))
    return None


def secret_at(text: str, after: int) -> tuple[int, int] | None:
    """The value set after a cue by a colon or an equals sign, quoted or not: 8 characters or more, with a digit."""
    n, start = len(text), after
    while start < n and start - after < 3 and text[start] in " \"'":
        start += 1
    if start >= n or text[start] not in ":=":
        return None
    start += 1
    sign = start
    while start < n and start - sign < 3 and text[start] in " \"'":
        start += 1
    end = start
    while end < n and text[end] in SECRET:
        end += 1
    while end > start and text[end - 1] in ".-/":
        end -= 1
    return (start, end) if end - start >= 8 and any(c in DIGITS for c in text[start:end]) else None


def run_end(text: str, at: int) -> int:
    """The end of the letters, digits, hyphens and underscores from a place on."""
    while at < len(text) and text[at] in KEY:
        at += 1
    return at


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each list in order of start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email = ip = card = phone = url = account = secret = run = 0  # where each kind's scan may go on; end of the last run that began with a key
    for last, (what, size) in automaton().iter(text):
        at = last - size + 1
        if what == "digit":
            if at >= ip:
                ip, ok = ip_at(text, at)
                if ok:
                    out["ip"].append((at, ip))
            if at >= card:
                card, ok = card_at(text, at)
                if ok:
                    out["card"].append((at, card))
        elif what == "at":
            if found := email_at(text, at, email):
                out["email"].append(found)
                email = found[1]
        elif what == "plus":
            if at >= phone and (got := phone_at(text, at)):
                phone = got[0]
                if got[1]:
                    out["phone"].append((at, phone))
        elif what == "url":
            if at >= url:
                url, ok = url_at(text, at, last + 1)
                if ok:
                    out["url"].append((at, url))
        elif what == "key":  # a key does not go on from a word before it; starts in one run share its end
            if at >= secret and (at == 0 or text[at - 1] not in ALNUM):
                run = run if last < run else run_end(text, last + 1)
                if run - last - 1 >= KEY_STARTS[text[at : last + 1]]:
                    out["secret"].append((at, run))
                    secret = run
        elif what == "secret":
            found = secret_at(text, last + 1)
            if found and found[0] >= secret:
                out["secret"].append(found)
                secret = found[1]
        elif at >= account and (at == 0 or text[at - 1] not in ALNUM) and (found := account_at(text, last + 1)):
            out["account"].append(found)
            account = found[1]
    return out


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def private_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base kinds), n_url, n_account, n_secret, n_spans (all kinds), base_sha256, spans: one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            found = [find_spans(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([len(s[k]) for s in found], pa.int64()) for k in KINDS]
            total = pa.array([sum(map(len, s.values())) for s in found], pa.int64())
            digest = [hashlib.sha256(listed(s, BASE).encode()).hexdigest() for s in found]
            yield pa.record_batch([batch.column(0), *counts, total, pa.array(digest, pa.string()), pa.array([listed(s, KINDS) for s in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "n_spans", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", n_spans long, base_sha256 string, spans string")


def mask_spans(text: str, kinds: tuple[str, ...] = KINDS) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the one that starts first."""
    spans = find_spans(text)
    out, at = [], 0
    for a, b, k in sorted((a, -b, k) for k in kinds for a, b in spans[k]):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
            at = -b
    return "".join(out) + text[at:]
