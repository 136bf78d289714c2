"""Small tables and plain-Python versions of the operators."""

import random

BLOB_SCHEMA = "log_offset long, uid long, repo_id string, blob_id string, blob_size long, has_blob boolean, path string, valid_from_ns long, bucket int, side string, _first string, h long"


def blob_log(seed, n=300, uids=220, keys=4, times=40, nulls=True, hot=0.4):
    r = random.Random(seed)
    rows = []
    for off in r.sample(range(10 * n), n):
        key = 0 if r.random() < hot else r.randrange(keys)
        maybe = lambda v: None if nulls and r.random() < 0.04 else v
        spell = r.choice([str.upper, str.lower, lambda s: f" {s}\t"])
        rows.append((off, maybe(r.randrange(uids)), maybe(spell(f"r{key}")), maybe(spell("b0")), maybe(r.randrange(3)), maybe(r.random() < 0.5), None, maybe(r.randrange(times)), 1, "x", "y", 7))
    return rows


def tidy(x):
    return None if x is None else x.strip(" \t\n\r\x0b\x0c\xa0").lower()


def first_by_uid(rows, uid=1, off=0):
    best = {}
    for x in rows:
        if x[uid] not in best or x[off] < best[x[uid]][off]:
            best[x[uid]] = x
    return list(best.values())


def brute_history(rows):
    """(repo, blob, from, to, has_blob) from rows (offset, uid, repo, blob, size, has, path, ns, ...)."""
    series = {}
    for x in first_by_uid(rows):
        if x[7] is not None:
            cell = series.setdefault((tidy(x[2]), tidy(x[3])), {})
            if x[7] not in cell or x[0] > cell[x[7]][0]:
                cell[x[7]] = (x[0], x[5])
    out = []
    for key, cell in series.items():
        versions = []
        for ns in sorted(cell):
            if not versions or versions[-1][1] != cell[ns][1]:
                versions.append((ns, cell[ns][1]))
        for (ns, has), nxt in zip(versions, [v[0] for v in versions[1:]] + [0]):
            out.append((*key, ns, nxt, has))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda t: tuple((x is not None, str(x)) for x in t))


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda t: tuple((x is not None, str(x)) for x in t))
