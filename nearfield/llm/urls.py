"""URL filter on a memory-mapped, sorted array of 64-bit digests.

The table holds one entry for each rule ``host + path``: its XXH64 in a sorted
array, its verdict, and the full string that confirms a hit. A url is probed
with the host suffixes and path prefixes whose lengths some rule has, all of
them in one vectorised binary search for each batch; so a url's probes are
bounded by the rules, however long its host.
"""

from __future__ import annotations

import mmap
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import key_frame, map_batches, put_file

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
VERDICTS = ("allow", "block")
MAGIC = b"NFURL002"


@dataclass(frozen=True)
class Rule:
    """A rule fits its host and all its subdomains where the url's path starts with path."""

    verdict: str
    host: str
    path: str = ""

    def text(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    cut = rest.find("/", 0, end)
    host = rest[: cut if cut >= 0 else end]
    return host.translate(LOWER), rest[cut:end] if cut >= 0 else ""


def pack(rules: list[Rule]) -> bytes:
    """The table's file: magic, counts, lengths of host and path, sorted keys, string offsets, verdicts, strings."""
    seen: dict[str, Rule] = {}
    for r in rules:
        if r.verdict not in VERDICTS:
            raise ValueError(f"unknown verdict {r.verdict!r}")
        if seen.setdefault(r.text(), r).verdict != r.verdict:
            raise ValueError(f"two verdicts for {r.text()!r}")
    found = sorted((xxhash.xxh64_intdigest(t.encode()), t.encode(), VERDICTS.index(r.verdict)) for t, r in seen.items())
    lengths = sorted({(len(r.host), len(r.path)) for r in seen.values()})
    offsets = np.cumsum([0, *(len(t) for _, t, _ in found)])
    parts = [
        MAGIC,
        np.array([len(found), len(lengths)], "<u8").tobytes(),
        np.array(lengths, "<u8").tobytes(),
        np.array([k for k, _, _ in found], "<u8").tobytes(),
        offsets.astype("<u8").tobytes(),
        bytes(v for _, _, v in found),
        b"".join(t for _, t, _ in found),
    ]
    return b"".join(parts)


class DigestTable:
    """The packed table, mapped from a file (or from bytes, in tests)."""

    def __init__(self, buffer: bytes | mmap.mmap):
        if bytes(buffer[:8]) != MAGIC:
            raise ValueError("not a digest table")
        n, m = (int(x) for x in np.frombuffer(buffer, "<u8", 2, 8))
        at = 24
        self.lengths: dict[int, list[int]] = {}  # of paths, by length of host
        for host, path in np.frombuffer(buffer, "<u8", 2 * m, at).reshape(-1, 2).tolist():
            self.lengths.setdefault(host, []).append(path)
        self.longest = max(self.lengths, default=0)
        at += 16 * m
        self.keys = np.frombuffer(buffer, "<u8", n, at)
        at += 8 * n
        self.offsets = np.frombuffer(buffer, "<u8", n + 1, at)
        at += 8 * (n + 1)
        self.verdicts = np.frombuffer(buffer, "u1", n, at)
        self.base = at + n
        self.buffer = buffer

    @classmethod
    def open(cls, path: str) -> DigestTable:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def string(self, i: int) -> bytes:
        return bytes(self.buffer[self.base + int(self.offsets[i]) : self.base + int(self.offsets[i + 1])])

    def match(self, hosts: list[str], paths: list[str]) -> list[int]:
        """The longest fitting rule's index for each host and path, or -1."""
        owner: list[int] = []
        probes: list[bytes] = []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            at = max(0, len(host) - self.longest - 1)  # no rule's host begins further left
            if at:
                at = host.find(".", at) + 1 or -1
            while at >= 0 and host:
                found = [n for n in self.lengths.get(len(host) - at, ()) if n <= len(path)]
                probes += [(host[at:] + path[:n]).encode() for n in found]
                owner += [i] * len(found)
                at = host.find(".", at) + 1 or -1
        best = [-1] * len(hosts)
        if not probes or not len(self.keys):
            return best
        digests = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        found = np.searchsorted(self.keys, digests)
        hits = np.flatnonzero(self.keys[np.minimum(found, len(self.keys) - 1)] == digests)
        length = [-1] * len(hosts)
        for j in hits.tolist():
            k, probe, i = int(found[j]), probes[j], owner[j]
            while k < len(self.keys) and self.keys[k] == digests[j]:  # equal digests of different strings stand side by side
                if self.string(k) == probe and len(probe) > length[i]:
                    best[i], length[i] = k, len(probe)
                k += 1
        return best


def filter_urls(spark: SparkSession, pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """A row for each page: its key, host, path, the rule that decides (or null) and the verdict.

    A null url, or one without ``://``, has an empty host and path and gets the
    default verdict, as does any url that no rule fits. Repeated rows are each
    judged; an empty table gives an empty result. Only key and url are read, so
    extra columns do no harm. The table is as large as the rules, not the data;
    each executor fetches its file once and maps it.
    """
    name = put_file(spark, "urls", pack(rules))
    frame = key_frame(pages, key, url)
    kind = frame.schema[key].dataType.simpleString()
    tables: dict[str, DigestTable] = {}

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        if name not in tables:
            tables[name] = DigestTable.open(SparkFiles.get(name))
        table = tables[name]
        parts = [split_url(u) for u in batch.column(1).to_pylist()]
        hosts, paths = [h for h, _ in parts], [p for _, p in parts]
        best = table.match(hosts, paths)
        rule = [table.string(k).decode() if k >= 0 else None for k in best]
        verdict = [VERDICTS[table.verdicts[k]] if k >= 0 else default for k in best]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, rule, verdict))], [key, "host", "path", "rule", "verdict"])

    return map_batches(frame, f"`{key}` {kind}, host string, path string, rule string, verdict string", judge)
