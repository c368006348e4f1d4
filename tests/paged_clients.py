"""Clients that answer as told, right or wrong."""

import os


def objects(options):
    return Objects(options)


class Objects:
    """Object names below two prefixes. fault: what the answers do wrong."""

    def __init__(self, options):
        self.fault = options.get("fault")
        self.names = [f"{p}/{i:03d}" for p in ("a", "b") for i in range(25)]

    def prefixes(self):
        return ["a/", "b/"]

    def listed(self, prefix, token, limit):
        mine = [n for n in self.names if n.startswith(prefix)]
        at = int(token or 0)
        rows = [{"key": n, "size": len(n)} for n in mine[at : at + limit]]
        more = at + limit if at + limit < len(mine) else None
        if self.fault == "token" and token:
            more = int(token)
        if self.fault == "key" and token:
            rows = [{"key": mine[0], "size": 1}]
        if self.fault == "shape":
            return rows
        if self.fault == "endless":
            rows, more = [], at + 1
        return rows, (None if more is None else str(more))


class Numbers:
    """Rows 0, 3, 6 and so on. A file tells how many there are; `lost` makes pages short, `back` turns keys round."""

    def __init__(self, options):
        with open(options["file"]) as f:
            n = int(f.read())
        self.fault = options.get("fault")
        self.rows = [{"id": 3 * i, "v": f"v{i}"} for i in range(n)]
        if "calls" in options:
            with open(options["calls"], "a") as f:
                f.write(f"{os.getpid()}\n")

    def bounds(self):
        return (self.rows[0]["id"], self.rows[-1]["id"]) if self.rows else None

    def count(self):
        return len(self.rows)

    def after(self, key, upto, limit, first):
        found = [r for r in self.rows if (r["id"] >= key if first else r["id"] > key) and r["id"] <= upto]
        if self.fault == "back":
            found = found[::-1]
        return found[: limit + 1] if self.fault == "long" else found[:limit]

    def at(self, offset, limit):
        return self.rows[offset : offset + limit - (self.fault == "lost" and offset > 10)]
