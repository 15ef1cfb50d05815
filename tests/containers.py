"""Writes small help containers, for tests of the decoders."""

import struct


def tree(entries, pages=1):
    """A tree of one level with its entries dealt over leaf pages."""
    per = max(1, -(-len(entries) // pages))
    size, body = 2048, b""
    groups = [entries[i : i + per] for i in range(0, len(entries), per)] or [[]]
    for k, group in enumerate(groups):
        after = k + 1 if k + 1 < len(groups) else -1
        body += (struct.pack("<Hhhh", 0, len(group), k - 1, after) + b"".join(group)).ljust(size, b"\0")
    levels, root = 1, 0
    if len(groups) > 1:
        body += struct.pack("<Hhh", 0, 0, 0).ljust(size, b"\0")
        levels, root = 2, len(groups)
    return struct.pack("<HHH16s6hi", 0x293B, 2, size, b"z4", 0, 0, root, -1, len(groups) + levels - 1, levels, len(entries)) + body


def internal(data):
    return struct.pack("<iiB", len(data) + 9, len(data), 0) + data


def container(files):
    """A container of internal files (name to bytes)."""
    body, offsets, at = b"", {}, 16
    for name, data in files.items():
        offsets[name] = at
        body += internal(data)
        at = 16 + len(body)
    directory = internal(tree([n.encode() + b"\0" + struct.pack("<i", o) for n, o in sorted(offsets.items())]))
    return struct.pack("<4i", 0x00035F3F, at, -1, at + len(directory)) + body + directory


def system(records=(), minor=21, flags=0):
    body = b"".join(struct.pack("<HH", k, len(d)) + d for k, d in records)
    return struct.pack("<HHHlH", 0x036C, minor, 1, 0, flags) + body


def squeeze(data):
    """LZ77 by greedy search."""
    out, flags, count, group = bytearray(), 0, 0, bytearray()
    i = 0
    while i < len(data):
        best = (0, 0)
        for back in range(1, min(i, 4096) + 1):
            n = 0
            while n < 18 and i + n < len(data) and data[i - back + n] == data[i + n]:
                n += 1
            if n > best[0]:
                best = (n, back)
        if best[0] >= 3:
            flags |= 1 << count
            group += struct.pack("<H", best[1] - 1 | (best[0] - 3) << 12)
            i += best[0]
        else:
            group.append(data[i])
            i += 1
        count += 1
        if count == 8:
            out += bytes([flags]) + group
            flags, count, group = 0, 0, bytearray()
    return bytes(out + bytes([flags]) + group) if count else bytes(out)


def links(records):
    """Topic links of (type, LinkData1, LinkData2, length of LinkData2 once expanded), after each other."""
    out, at = b"", 12
    for k, (kind, one, two, length) in enumerate(records):
        size = 21 + len(one) + len(two)
        after = at + size if k + 1 < len(records) else -1
        out += struct.pack("<5iB", size, length, -1, after, 21 + len(one), kind) + one + two
        at += size
    return out


def heading(title, macros=(), back=-1, forward=-1):
    one = struct.pack("<7i", 0, back, forward, 0, -1, -1, -1)
    two = title + b"\0" + b"".join(m + b"\0" for m in macros)
    return 2, one, two, len(two)


def display(commands, texts, packed=None):
    """A text record: commands after each string."""
    one = struct.pack("<H", (0 + 16384) * 2) + bytes([20]) + bytes(4) + struct.pack("<H", 0) + b"".join(commands) + b"\xff"
    two = b"\0".join(texts) + b"\0"
    return 0x20, one, packed or two, len(two)


def topic(records, compress=False):
    body = links(records)
    head = struct.pack("<iii", -1, 12, -1)
    if not compress:
        return head + body
    return head + squeeze(body)
