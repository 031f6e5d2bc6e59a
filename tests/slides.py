"""Builds small slide containers for tests."""

from __future__ import annotations

import struct


def container(sections, order="<", big=False, chain_to=None, magic=None):
    """Bytes of a container. A section is a list of (tag, type, values); values are bytes for text, ints else, or ``payloads`` lists.

    ``("tiles", [payload, ...])`` and ``("strips", [...])`` stand for the payloads with their offsets and counts.
    """
    long_type, number, entry = (16, 8, 20) if big else (4, 4, 12)
    num = (lambda x: struct.pack(order + "Q", x)) if big else (lambda x: struct.pack(order + "I", x))
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 16: 8}
    fmt = {1: "B", 3: "H", 4: "I", 16: "Q"}
    out = bytearray(b"II" if order == "<" else b"MM")
    out += struct.pack(order + "H", magic or (43 if big else 42))
    if big:
        out += struct.pack(order + "HH", 8, 0)
    first_at = len(out)
    out += num(0)
    link = first_at
    starts = []
    for items in sections:
        tags = []
        for item in items:
            if item[0] in ("tiles", "strips"):
                offsets = []
                for p in item[1]:
                    offsets.append(len(out))
                    out += p
                o, c = (324, 325) if item[0] == "tiles" else (273, 279)
                tags += [(o, long_type, offsets), (c, long_type, [len(p) for p in item[1]])]
            else:
                tags.append(item)
        made = []
        for tag, kind, values in tags:
            data = values if isinstance(values, bytes) else b"".join(struct.pack(order + fmt[kind], v) for v in values)
            count = len(data) // sizes[kind]
            if len(data) <= number:
                cell = data.ljust(number, b"\0")
            else:
                cell = num(len(out))
                out += data
            made.append(struct.pack(order + "HH", tag, kind) + num(count) + cell)
        at = len(out)
        starts.append(at)
        out[link : link + number] = num(at)
        out += (struct.pack(order + "Q", len(made)) if big else struct.pack(order + "H", len(made))) + b"".join(made)
        link = len(out)
        out += num(0)
    if chain_to is not None:
        out[link : link + number] = num(starts[chain_to])
    return bytes(out)


def slide(text=b"Aperio Image|AppMag = 20\0", order="<", big=False, payload=b"\xaa" * 300):
    kind = 16 if big else 4
    main = [(256, 4, [512]), (257, 4, [256]), (259, 3, [7]), (270, 2, text), (322, 3, [256]), (323, 3, [256]), ("tiles", [payload, b"\xbb" * 8])]
    strip = [(254, 4, [1]), (256, 4, [40]), (257, 4, [30]), (259, 3, [1]), (270, 2, b"label\0"), ("strips", [b"\xcc" * 64])]
    assert kind
    return container([main, strip], order, big)
