"""The draws of ``scalars.draw`` for whole ranges of counters at once."""

from __future__ import annotations

BATCH = 8192


def _steps():
    """(constant, turn, word) of the 64 steps of MD5 (RFC 1321)."""
    import math

    turns = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
    words = (lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16)
    return [(int(2**32 * abs(math.sin(i + 1))) % 2**32, turns[i // 16][i % 4], words[i // 16](i)) for i in range(64)]


STEPS = _steps()


def leading_bits(words: list, size: int):
    """The leading 60 bits of the MD5 of ``size`` messages of one block; a word is an array or one number for all."""
    import numpy as np

    start = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(size, v, np.uint32) for v in start)
    f, g = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i, (constant, turn, word) in enumerate(STEPS):
        if i < 16:  # (b & c) | (~b & d)
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:  # (d & b) | (~d & c)
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        if isinstance(words[word], int):
            f += np.uint32((words[word] + constant) % 2**32)
        else:
            f += words[word]
            f += np.uint32(constant)
        np.right_shift(f, np.uint32(32 - turn), out=g)
        np.left_shift(f, np.uint32(turn), out=f)
        np.bitwise_or(f, g, out=f)
        f += b
        a, b, c, d, f = d, f, b, c, a
    high, low = ((v + s).byteswap().astype(np.uint64) for v, s in ((a, start[0]), (b, start[1])))
    return (high << np.uint64(28)) | (low >> np.uint64(4))


def _digits(first: int, last: int, at: int):
    """The counters first .. last - 1, all of as many digits, as bytes from place ``at`` of a block, by words; with the end of the message."""
    import numpy as np

    n, size = np.arange(first, last, dtype=np.int64), len(str(first))
    block = np.zeros((last - first, 64), np.uint8)
    for k in range(size - 1, -1, -1):
        n, digit = n // 10, n % 10
        block[:, at + k] = digit + 48
    block[:, at + size] = 128
    block[:, 56:].view("<u8")[:] = 8 * (at + size)
    return np.ascontiguousarray(block.view("<u4").T), at // 4, (at + size) // 4


def draws(seed: int, numbers: range, n: int):
    """Yield (number, indices in [0, n)) for the draws ``scalars.draw(seed, number, i, n)`` of i = 0 .. n - 1, a batch of i at a time."""
    import numpy as np

    first = 0
    while first < n:
        last = min(n, first + BATCH, 10 ** len(str(first)))
        tails = {}
        for number in numbers:
            head = f"{seed}:{number}:".encode()
            if len(head) not in tails:
                tails[len(head)] = _digits(first, last, len(head))
            words, lo, hi = tails[len(head)]
            fixed = np.frombuffer(head.ljust(64, b"\0"), "<u4")
            message = [words[k] | fixed[k] if lo <= k <= hi else int(words[k, 0] | fixed[k]) for k in range(16)]
            bits = leading_bits(message, last - first)
            yield number, (bits - bits // np.uint64(n) * np.uint64(n)).astype(np.int64)
        first = last
