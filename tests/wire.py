"""One message at a time for the decoders of whole batches."""

import numpy as np


def decoded(decode, data, **limits):
    """The fields of one message between two others, which must not change it."""
    around = b"\x16\x03\x01\x00\x05"
    raw = np.frombuffer(around + data + around + bytes(8), np.uint8)
    begin = np.array([0, len(around), len(around) + len(data)])
    found = decode(raw, begin, np.r_[begin[1:], len(raw) - 8], **limits)
    return {name: column[1].as_py() for name, column in found.items()}
