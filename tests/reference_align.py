"""Brute force: the recurrence cell by cell."""


def brute(a, b, score, gi, ge):
    """(score, a_begin, a_end, b_begin, b_end) by scalar loops; a, b: strings."""

    def forward(a, b):
        best, ae, be = 0, 0, 0
        h = [0] * (len(a) + 1)
        e = [-(10**9)] * (len(a) + 1)
        for i in range(len(b)):
            f = -(10**9)
            prev = h[:]
            for j in range(1, len(a) + 1):
                e[j] = max(prev[j] + gi + ge, e[j] + ge)
                f = max(h[j - 1] + gi + ge, f + ge)
                h[j] = max(0, prev[j - 1] + score(a[j - 1], b[i]), e[j], f)
                if h[j] > best:
                    best, ae, be = h[j], j - 1, i
        return best, ae, be

    s, ae, be = forward(a, b)
    if s == 0:
        return 0, 0, 0, 0, 0
    _, ra, rb = forward(a[: ae + 1][::-1], b[: be + 1][::-1])
    return s, ae - ra, ae, be - rb, be
