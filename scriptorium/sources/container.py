"""Compound files: allocation chains, the directory and its streams, from the bytes of one file."""

from __future__ import annotations

import struct

BLOCK, SMALL, LIMIT = 512, 64, 4096
END, FREE, NONE = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFF
DEPTH = 25


class Damaged(Exception):
    """The file contradicts itself; it becomes a row with this error."""


def longs(raw: bytes, at: int, n: int) -> tuple[int, ...]:
    return struct.unpack_from(f"<{n}I", raw, at) if len(raw) >= at + 4 * n else struct.unpack(f"<{(len(raw) - at) // 4}I", raw[at : at + (len(raw) - at) // 4 * 4])


class Container:
    def __init__(self, content: bytes):
        self.raw = content
        self.n = len(content) // BLOCK - 1  # blocks after the header
        head = self.block(-1)
        n_table, root, small, extra = (struct.unpack_from("<I", head, at)[0] for at in (0x2C, 0x30, 0x3C, 0x44))
        numbers = list(longs(head, 0x4C, 109))
        seen: set[int] = set()
        while extra not in (END, FREE) and len(numbers) < n_table:
            if extra in seen or extra >= self.n:
                raise Damaged("extension of the allocation table")
            seen.add(extra)
            part = longs(self.block(extra), 0, 128)
            numbers += part[:127]
            extra = part[127]
        self.table: list[int] = []
        for b in numbers[:n_table]:
            if b < self.n:
                self.table += longs(self.block(b), 0, 128)
        self.table = self.table[: self.n]
        self.entries = self.directory(self.chained(root))
        top = self.entries[0] if self.entries else None
        self.small_table = list(longs(x := self.chained(small), 0, len(x) // 4)) if small not in (END, FREE) else []
        self.small_stream = self.chained(top["start"]) if top and top["size"] and top["start"] not in (END, FREE) else b""

    def block(self, i: int) -> bytes:
        return self.raw[(i + 1) * BLOCK : (i + 2) * BLOCK].ljust(BLOCK, b"\0")

    def chain(self, start: int, table: list[int]) -> list[int]:
        out, seen = [], set()
        while start != END:
            if start >= len(table) or start in seen:
                raise Damaged("the block depot is damaged")
            seen.add(start)
            out.append(start)
            start = table[start]
        return out

    def chained(self, start: int) -> bytes:
        return b"".join(self.block(i) for i in self.chain(start, self.table)) if start not in (END, FREE) else b""

    def directory(self, raw: bytes) -> list[dict]:
        """Entries with their level in the tree; links out of range are an error."""
        out = []
        for at in range(0, len(raw) - 127, 128):
            length = struct.unpack_from("<H", raw, at + 0x40)[0]
            prev, next_, child = longs(raw, at + 0x44, 3)
            start, size = longs(raw, at + 0x74, 2)
            name = raw[at : at + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
            out.append({"idx": len(out), "name": name, "type": raw[at + 0x42], "prev": prev, "next": next_, "child": child, "start": start, "size": size, "level": None})
        for e in out:
            if any(x != NONE and x >= len(out) for x in (e["prev"], e["next"], e["child"])):
                raise Damaged("a directory entry points nowhere")
        stack = [(0, 0)] if out else []
        while stack:
            i, level = stack.pop()
            if out[i]["level"] is not None or level > DEPTH:
                continue
            out[i]["level"] = level
            stack += [(x, level) for x in (out[i]["prev"], out[i]["next"]) if x != NONE]
            if out[i]["child"] != NONE:
                stack.append((out[i]["child"], level + 1))
        return out

    def find(self, name: str) -> dict | None:
        """The first stream of a name right under the root."""
        return next((e for e in self.entries if e["level"] == 1 and e["type"] == 2 and e["name"] == name), None)

    def stream(self, name: str) -> bytes | None:
        e = self.find(name)
        if e is None:
            return None
        if e["size"] >= LIMIT:
            return self.chained(e["start"])[: e["size"]]
        if not e["size"]:
            return b""
        return b"".join(self.small_stream[i * SMALL : (i + 1) * SMALL] for i in self.chain(e["start"], self.small_table))[: e["size"]]
