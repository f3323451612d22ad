"""URL rules by a bit-parallel wildcard automaton (multiword Shift-And).

Every rule becomes a glob over the canonical URL ``.host NUL path``; all globs are
packed side by side into 64-bit words and simulated together, one byte of every URL of
an Arrow batch per step:  ``D' = ((D << 1) & B[c]) | (D & L[c])``.  ``B`` holds the
literal transitions, ``L`` the self-loops of the wildcards.  There is no shuffle and no
per-URL Python loop; a batch of URLs is advanced as one NumPy matrix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.common import ascii_lower, fresh

_SEP = 0  # stands between host and path; never crossed by a single star
#: Bits of one automaton; longer rule lists run in several automata one after the other.
BLOCK_BITS = 1 << 16
#: Bytes of state that one step may touch.
_STATE_BYTES = 1 << 25


@dataclass(frozen=True)
class Rule:
    """``text`` is ``host/path``; it fits the host, its subdomains, and paths that start with the path."""

    verdict: str
    text: str

    def glob(self) -> list[tuple[str, int]]:
        """Tokens ``(kind, byte)``: lit, any (``?``), star (``*``, stays on its side), rest (any tail)."""
        host, slash, tail = self.text.partition("/")
        wild = {ord("*"): "star", ord("?"): "any"}
        body = [(wild.get(b, "lit"), b) for b in f".{host}".encode()]
        body.append(("lit", _SEP))
        body += [(wild.get(b, "lit"), b) for b in (slash + tail).encode()]
        return [("star", 0), *body, ("rest", 0)]


def parse_rules(lines: Sequence[str]) -> list[Rule]:
    """Rules from lines such as ``block net/``; blank lines are skipped."""
    rules = []
    for line in lines:
        parts = line.split()
        if not parts:
            continue
        if len(parts) != 2 or parts[0] not in ("allow", "block"):
            raise ValueError(f"not a rule: {line!r}")
        rules.append(Rule(*parts))
    return rules


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path): host between ``://`` and ``/ ? #`` with A-Z lower-cased, path up to ``? #``.

    Both are empty for a null URL or one without ``://``.
    """
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return ascii_lower(raw), path


class Automaton:
    """All rules of one block, packed into words of 64 bits."""

    def __init__(self, rules: Sequence[Rule]):
        globs = [r.glob() for r in rules]
        states = [sum(kind in ("lit", "any") for kind, _ in g) + 1 for g in globs]
        self.words = (sum(states) + 63) // 64
        step = np.zeros((256, self.words * 64), np.uint8)
        loop = np.zeros((256, self.words * 64), np.uint8)
        start = np.zeros(self.words * 64, np.uint8)
        side = np.ones(256, np.uint8)
        side[_SEP] = 0
        self.final, at = [], 0
        for g in globs:
            start[at] = 1
            for kind, byte in g:
                if kind == "lit":
                    at += 1
                    step[byte, at] = 1
                elif kind == "any":
                    at += 1
                    step[:, at] = side
                elif kind == "star":
                    loop[:, at] |= side
                else:
                    loop[:, at] = 1
            self.final.append(at)
            at += 1
        self.step, self.loop, self.start = (self._pack(x) for x in (step, loop, start[None]))

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def match(self, strings: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix (string, rule)."""
        out = np.zeros((len(strings), len(self.final)), bool)
        rows = max(1, _STATE_BYTES // (self.words * 8))
        for lo in range(0, len(strings), rows):
            part = strings[lo:lo + rows]
            size = np.fromiter(map(len, part), np.int64, len(part))
            order = np.argsort(-size, kind="stable")
            flat = np.frombuffer(b"".join(part) or b"\0", np.uint8)
            first = (np.cumsum(size) - size)[order]
            live = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), side="left")
            state = np.repeat(self.start, len(part), axis=0)
            for pos, n in enumerate(live):
                byte = flat[first[:n] + pos]
                now = state[:n]
                moved = now << np.uint64(1)
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                state[:n] = (moved & self.step[byte]) | (now & self.loop[byte])
            for k, bit in enumerate(self.final):
                out[lo + order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
        return out


def _blocks(rules: Sequence[Rule]) -> Iterator[tuple[int, list[Rule]]]:
    at, bits, block = 0, 0, []
    for k, r in enumerate(rules):
        n = len(r.glob())
        if block and bits + n > BLOCK_BITS:
            yield at, block
            at, bits, block = k, 0, []
        block.append(r)
        bits += n
    if block:
        yield at, block


def judge_urls(df: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host, path, rule, verdict`` to every row; columns of these names are replaced.

    The longest fitting rule decides; of equally long ones a block goes before an allow,
    then the smaller text.  No fitting rule: ``rule`` is null and the verdict is
    ``default``.  A null URL or one without ``://`` has an empty host and path.  Repeated
    rows stay repeated; an empty table gives an empty table.
    """
    ranked = sorted(set(rules), key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    host, path = canonical(F.col(url))

    @F.pandas_udf("int")
    def best(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        machines = [(at, Automaton(block)) for at, block in _blocks(ranked)]
        for hosts, paths in batches:
            urls = [b".%s\0%s" % (h.encode().replace(b"\0", b"\1"), p.encode()) for h, p in zip(hosts, paths)]
            found = np.full(len(urls), -1, np.int32)
            for at, machine in machines:
                hit = machine.match(urls)
                some = hit.any(axis=1) & (found < 0)
                found[some] = at + hit[some].argmax(axis=1)
            yield pd.Series(found)

    none = F.lit(None).cast("string")
    texts = F.array(*[F.lit(r.text) for r in ranked], none)
    verdicts = F.array(*[F.lit(r.verdict) for r in ranked], F.lit(default))
    own = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    h, p, k = (fresh(df, c) for c in ("__host", "__path", "__k"))
    out = df.withColumns({h: host, p: path}).withColumn(k, best(h, p))
    at = F.when(F.col(k) < 0, len(ranked)).otherwise(F.col(k))
    return out.select(*own, F.col(h).alias("host"), F.col(p).alias("path"), F.get(texts, at).alias("rule"), F.get(verdicts, at).alias("verdict"))

