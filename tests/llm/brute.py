"""Plain reference versions the operators are tested against."""


def components(n, links):
    """Smallest index reachable from each of n nodes."""
    low = list(range(n))

    def root(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]
