"""Writers of small binary documents for the tests."""

import struct


def dos(text: bytes, fast: bool = False) -> bytes:
    head = bytearray(128)
    head[:6] = b"\x31\xbe\0\0\0\xab"
    struct.pack_into("<I", head, 0x0E, 128 + len(text))
    head[0x75] = 2 if fast else 0
    return bytes(head) + text


def mac(text: bytes, five: bool = False, fast: bool = False) -> bytes:
    head = bytearray(256)
    head[:6] = b"\xfe\x37\0\x23\0\0" if five else b"\xfe\x37\0\x1c\0\0"
    head[0x0A] = 0x20 if fast else 0
    struct.pack_into(">2I", head, 0x14, 256, 256 + len(text))
    return bytes(head) + text


def win(text: bytes, one: bool = False, flags: int = 0) -> bytes:
    head = bytearray(384)
    head[:4] = b"\x9b\xa5\x21\0" if one else b"\xdb\xa5\x2d\0"
    struct.pack_into("<H", head, 0x0A, flags)
    struct.pack_into("<I", head, 0x18, 384)
    struct.pack_into("<I", head, 0x34, len(text))
    return bytes(head) + text


def container(streams: dict[str, bytes]) -> bytes:
    """A compound file whose streams are all in the big table."""
    blocks: list[bytes] = []
    table: list[int] = []

    def put(raw: bytes) -> int:
        first = len(blocks)
        parts = [raw[i : i + 512].ljust(512, b"\0") for i in range(0, max(len(raw), 1), 512)]
        blocks.extend(parts)
        table.extend([first + i + 1 for i in range(len(parts) - 1)] + [0xFFFFFFFE])
        return first

    starts = {n: put(s) for n, s in streams.items()}

    def entry(name: str, kind: int, child=0xFFFFFFFF, nxt=0xFFFFFFFF, start=0, size=0) -> bytes:
        e = bytearray(128)
        raw = name.encode("utf-16-le")
        e[: len(raw)] = raw
        struct.pack_into("<H", e, 0x40, len(raw) + 2 if name else 0)
        e[0x42] = kind
        struct.pack_into("<3I", e, 0x44, 0xFFFFFFFF, nxt, child)
        struct.pack_into("<2I", e, 0x74, start, size)
        return bytes(e)

    names = list(streams)
    root = entry("Root Entry", 5, child=1 if names else 0xFFFFFFFF)
    entries = [root] + [entry(n, 2, nxt=i + 2 if i + 1 < len(names) else 0xFFFFFFFF, start=starts[n], size=len(streams[n])) for i, n in enumerate(names)]
    while len(entries) % 4:
        entries.append(entry("", 0))
    root_at = put(b"".join(entries))
    n = len(blocks)
    k = 1
    while 128 * k < n + k:
        k += 1
    table += [0xFFFFFFFD] * k
    table += [0xFFFFFFFF] * (128 * k - len(table))
    blocks += [struct.pack("<128I", *table[128 * i : 128 * i + 128]) for i in range(k)]
    head = bytearray(512)
    head[:8] = bytes.fromhex("d0cf11e0a1b11ae1")
    struct.pack_into("<I", head, 0x2C, k)
    struct.pack_into("<I", head, 0x30, root_at)
    struct.pack_into("<2I", head, 0x3C, 0xFFFFFFFE, 0)
    struct.pack_into("<I", head, 0x44, 0xFFFFFFFE)
    struct.pack_into("<109I", head, 0x4C, *([n + i for i in range(k)] + [0xFFFFFFFF] * (109 - k)))
    return bytes(head) + b"".join(blocks)


def page(runs: list[tuple[int, int, bytes]], stride: int, paragraph: bool) -> bytes:
    """A 512-byte page of runs (from, to, properties); a paragraph's properties begin with its style."""
    out = bytearray(512)
    n = len(runs)
    struct.pack_into(f"<{n + 1}I", out, 0, *[r[0] for r in runs], runs[-1][1])
    at = 511
    for i, (_, _, props) in enumerate(runs):
        if not props:
            continue
        body = bytes([len(props)]) + props
        if paragraph:
            props += b"\0" * ((len(props) + 1) % 2)
            body = bytes([(len(props) + 1) // 2]) + props
        at = (at - len(body)) // 2 * 2
        out[at : at + len(body)] = body
        out[4 * (n + 1) + i * stride] = at // 2
    out[511] = n
    return bytes(out)


def word8(pieces: list[tuple[bytes, bool]], lengths: list[int], flags: int = 0, paragraphs=(), characters=(), footnotes=(), endnotes=(), mods: bytes = b"", order=None, extra: dict | None = None, tables: dict | None = None, sizes: dict | None = None) -> bytes:
    """A version 8 document.  pieces: (bytes, 16-bit) in text order; order: their order in the file.  Runs count from the text's start."""
    head = bytearray(1024)
    struct.pack_into("<2H", head, 0, 0xA5EC, 193)
    struct.pack_into("<H", head, 0x0A, flags | 0x200)
    struct.pack_into("<I", head, 0x18, 1024)
    for i, n in enumerate(lengths):
        struct.pack_into("<I", head, 0x4C + 4 * i, n)
    body, at = bytearray(), {}
    for i in order or range(len(pieces)):
        at[i] = 1024 + len(body)
        body += pieces[i][0]
        body += b"\0" * (len(body) % 2)
    main = bytearray(head + body)
    table = bytearray(4096)

    def place(where: int, raw: bytes) -> None:
        nonlocal table
        struct.pack_into("<2I", main, where, len(table), len(raw))
        table += raw

    cps, records = [0], b""
    for i, (raw, wide) in enumerate(pieces):
        cps.append(cps[-1] + len(raw) // (2 if wide else 1))
        offset = at[i] if wide else at[i] * 2 | 0x40000000
        records += struct.pack("<HIH", 0, offset, 0)
    n = len(pieces)
    place(0x1A2, mods + b"\x02" + struct.pack("<I", 4 + 12 * n) + struct.pack(f"<{n + 1}I", *cps) + records)
    for where, runs, stride in ((0x102, paragraphs, 13), (0xFA, characters, 1)):
        if runs:
            main += b"\0" * (-len(main) % 512)
            number = len(main) // 512
            main += page([(1024 + a, 1024 + z, p) for a, z, p in runs], stride, where == 0x102)
            place(where, struct.pack("<3I", 1024 + runs[0][0], 1024 + runs[-1][1], number))
    for where, refs in ((0xAA, footnotes), (0x20A, endnotes)):
        if refs:
            place(where, struct.pack(f"<{len(refs) + 1}I", *refs, cps[-1]) + struct.pack(f"<{len(refs)}H", *range(len(refs))))
    for where, raw in (tables or {}).items():
        place(where, raw)
        if where in (sizes or {}):
            struct.pack_into("<I", main, where + 4, sizes[where])
    main += b"\0" * max(0, 4096 - len(main))
    return container({"WordDocument": bytes(main), "1Table": bytes(table)} | (extra or {}))


def summary(title: str, author: str, created: int) -> bytes:
    """A property set stream of at least 4096 bytes."""
    props = []
    for pid, raw in ((2, struct.pack("<2I", 30, len(title) + 1) + title.encode() + b"\0"), (4, struct.pack("<2I", 30, len(author) + 1) + author.encode() + b"\0"), (12, struct.pack("<IQ", 64, created * 10_000_000 + 116_444_736_000_000_000))):
        props.append((pid, raw + b"\0" * (-len(raw) % 4)))
    at, index, body = 8 + 8 * len(props), b"", b""
    for pid, raw in props:
        index += struct.pack("<2I", pid, at + len(body))
        body += raw
    section = struct.pack("<2I", at + len(body), len(props)) + index + body
    return (struct.pack("<HHI", 0xFFFE, 0, 0) + b"\0" * 16 + struct.pack("<I", 1) + b"\0" * 16 + struct.pack("<I", 48) + section).ljust(4608, b"\0")


def word6(text: bytes, lengths: list[int], paragraphs=(), tables: dict | None = None) -> bytes:
    """A version 6 document of one piece; runs count from the text's start.  Tables lie in the document's own stream."""
    head = bytearray(768)
    struct.pack_into("<2H", head, 0, 0xA5DC, 101)
    struct.pack_into("<I", head, 0x18, 768)
    for i, n in enumerate(lengths):
        struct.pack_into("<I", head, 0x34 + 4 * i, n)
    main = bytearray(head + text)
    if paragraphs:
        main += b"\0" * (-len(main) % 512)
        number = len(main) // 512
        main += page([(768 + a, 768 + z, p) for a, z, p in paragraphs], 7, True)
        tables = {0xC0: struct.pack("<2IH", 768 + paragraphs[0][0], 768 + paragraphs[-1][1], number)} | (tables or {})
    for where, raw in (tables or {}).items():
        struct.pack_into("<2I", main, where, len(main), len(raw))
        main += raw
    main += b"\0" * max(0, 4096 - len(main))
    return container({"WordDocument": bytes(main)})
