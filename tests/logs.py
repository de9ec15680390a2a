"""Small logs and a plain model of what reads of them give."""

from tidemark.model import LOG_SCHEMA, TOMBSTONE, VALUE


def b(x):
    return x.encode() if isinstance(x, str) else x


def log(spark, rows):
    """rows: (key, seq, value or None for a delete)"""
    return spark.createDataFrame([(b(k), s, TOMBSTONE if v is None else VALUE, b(v)) for k, s, v in rows], LOG_SCHEMA)


def rows(df):
    return [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()]


def live(entries, seq=None):
    """{key: value} of (key, seq, value) entries up to seq."""
    newest = {}
    for k, s, v in sorted(entries, key=lambda e: e[1]):
        if seq is None or s <= seq:
            newest[b(k)] = b(v)
    return {k: v for k, v in sorted(newest.items()) if v is not None}


def retained(entries, keep_seq, bottommost):
    """Walk each key from new to old and stop at the first version that keep_seq sees."""
    out = []
    for key in sorted({b(k) for k, _, _ in entries}):
        versions = sorted(((s, b(v)) for k, s, v in entries if b(k) == key), reverse=True)
        if bottommost and versions[0][1] is None and (keep_seq is None or versions[0][0] <= keep_seq):
            continue
        for s, v in versions:
            out.append((key, s, v))
            if keep_seq is None or s <= keep_seq:
                break
    return sorted(out)
