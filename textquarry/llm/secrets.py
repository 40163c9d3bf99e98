"""Secret scans with multipart credential linking.

Parts of credentials are intervals of a text: access identifiers, secrets and endpoints, strong or
weak. An interval join links complementary parts that lie apart in one scope (within `scope_chars`
of each other and with no blank line between); weak candidates count only when such a part stands
beside them, never for what is inside themselves: a lone URL with an id in it, or a lone login, is
no credential. The strong base kinds are always reported, and no weak one overlaps them.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame

from textquarry.llm.common import map_texts


@dataclass(frozen=True)
class SecretParams:
    scope_chars: int = 300
    min_entropy: float = 3.5  #: bits a character of a weak secret
    mask: str = "[secret]"


KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A).finditer
access = re.compile(r"AKIA[A-Z0-9]+").finditer
#: Shorter runs fail and are dropped, and a run of 16 is never inside a match of a shorter one.
hexes = re.compile(r"[0-9a-f]{16,}").finditer
weak_id = re.compile(r"""(?:client_?id|access_?key|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})""", re.I | re.A).finditer
weak_secret = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])").finditer
endpoint = re.compile(r"(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}", re.I | re.A).finditer


def entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    out = [("assign", *m.span()) for m in assign(text) if len(m[2]) >= 12] if any(x in low for x in NAMES) or not text.isascii() else []
    if "AKIA" in text:
        out += [("access", *m.span()) for m in access(text) if m.end() - m.start() >= 18]
    return out + [("hex", *m.span()) for m in hexes(text)]


#: Parts that a weak kind is complementary to: a secret completes any identifier or endpoint, a strong identifier also an endpoint.
#: A weak secret inside an endpoint (an id of a public link, say) is part of that: only an identifier completes it, and no other endpoint.
COMPLEMENTS = {
    "weak_id": {"assign", "hex", "weak_secret", "inner_secret"},
    "endpoint": {"access", "assign", "hex", "weak_secret"},
    "weak_secret": {"access", "weak_id", "endpoint"},
    "inner_secret": {"access", "weak_id"},
}
blank_lines = re.compile(r"(?=(\n[ \t\r]*\n))").finditer


def _outside(weak: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The weak intervals that overlap no taken one: a sweep by start that holds the furthest end of all taken ones before."""
    taken = sorted((s, e) for _, s, e in taken)
    furthest = [*accumulate((e for _, e in taken), max)]
    out = []
    for kind, s, e in weak:
        before = bisect_left(taken, (e,))  # taken ones that start before the end
        if not before or furthest[before - 1] <= s:
            out.append((kind, s, e))
    return out


def linked_weak(text: str, base: list[tuple[str, int, int]], params: SecretParams) -> list[tuple[str, int, int, str]]:
    """Weak candidates outside the base spans, with a complementary part in their scope.

    A candidate's scope reaches `scope_chars` to both sides, but not over a blank line. Its partner
    overlaps it nowhere: it is the first part by end that ends in the scope before the candidate, or
    else the first by start after it. The interval join is two searches in the parts sorted by end
    and by start, so that any number of parts takes n log n.
    """
    weak, links_at = [], []
    if ":" in text or "=" in text:
        links_at = [m.span() for m in endpoint(text)]
        weak += [("weak_id", *m.span()) for m in weak_id(text)]
        weak += [("endpoint", *span) for span in links_at]
    if not base and not weak:
        return []
    link_starts = [s for s, _ in links_at]
    for m in weak_secret(text):
        if any(c.isdigit() for c in m[0]) and any(c.isupper() for c in m[0]) and any(c.islower() for c in m[0]) and entropy(m[0]) >= params.min_entropy:
            before = bisect_right(link_starts, m.start()) - 1  # endpoints don't overlap
            weak.append(("inner_secret" if before >= 0 and m.start() < links_at[before][1] else "weak_secret", *m.span()))
    weak = sorted(_outside(sorted({*weak}), base), key=lambda w: w[1:])
    if not weak:
        return []
    shown = lambda kind: "weak_secret" if kind == "inner_secret" else kind
    parts = [*base, *weak]
    others = {kind: [(s, e, KINDS.index(shown(k))) for k, s, e in parts if k in COMPLEMENTS[kind]] for kind in {w[0] for w in weak}}
    by_end = {kind: sorted((e, s, k) for s, e, k in some) for kind, some in others.items()}
    by_start = {kind: sorted(some) for kind, some in others.items()}
    blanks = [m.span(1) for m in blank_lines(text)]
    starts, ends = [s for s, _ in blanks], [e for _, e in blanks]
    links = []
    for kind, s, e in weak:
        before, after = bisect_right(ends, s) - 1, bisect_left(starts, e)
        least = max(s - params.scope_chars, starts[before] + 1 if before >= 0 else 0)
        most = min(e + params.scope_chars, ends[after] - 1 if after < len(ends) else len(text))
        i, j = bisect_left(by_end[kind], (least,)), bisect_left(by_start[kind], (e,))
        if i < len(by_end[kind]) and by_end[kind][i][0] <= s:
            to, at, k = by_end[kind][i]
        elif j < len(by_start[kind]) and by_start[kind][j][0] <= most:
            at, to, k = by_start[kind][j]
        else:
            continue
        links.append((shown(kind), s, e, f"{KINDS[k]}:{at}:{to}"))
    return links


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan_text(text: str | None, params: SecretParams = SecretParams()):
    """Base spans, linked weak spans with their partner."""
    base = base_spans(text or "")
    return base, linked_weak(text or "", base, params)


def masked(text: str | None, spans, mask: str) -> str | None:
    """The text with each union of overlapping spans replaced by the mask; the end of an assignment's quote stays."""
    if not text or not spans:
        return text
    out, at, to = [], 0, -1
    for _, s, e in sorted(((k, s, e) for k, s, e in spans), key=lambda x: (x[1], x[2])):
        if s > to:
            out += [text[at:s], mask]
            at = e
        at = max(at, e)
        to = max(to, e - 1)
    return "".join([*out, text[at:]])


def scan_secrets(df: DataFrame, params: SecretParams = SecretParams(), id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """One row for each row of df: the id, n_assign, n_access, n_hex, base_sha256, spans, links and, if with_text, masked_text.

    spans holds base and linked weak spans as kind:start:end (code points, end exclusive) by start
    and kind; links holds `weak span>partner`. A null text counts as empty: no spans, and masked_text
    stays null. Whole texts are scanned; repeated rows are scanned each.
    """

    def factory():
        def f(texts):
            cols = [[] for _ in range(6 + with_text)]
            for t in texts:
                base, links = scan_text(t, params)
                kinds = Counter(k for k, _, _ in base)
                spans = base + [x[:3] for x in links]
                row = [kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), ",".join(f"{k}:{s}:{e}>{o}" for k, s, e, o in links)]
                for c, x in zip(cols, [*row, masked(t, spans, params.mask)] if with_text else row):
                    c.append(x)
            return cols

        return f

    return map_texts(df, factory, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, links string" + ", masked_text string" * with_text, id_col, text_col, extra)
