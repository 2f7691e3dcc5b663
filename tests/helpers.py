"""Small frames and brute-force counterparts."""

import datetime as dt
import random

MATCH_SCHEMA = (
    "match_id bigint, match_date date, home_team string, away_team string, home_score int, "
    "away_score int, neutral boolean, tournament string, pool string"
)


def day(offset):
    return dt.date(2000, 1, 1) + dt.timedelta(days=offset)


def random_matches(n=300, teams=6, seed=1, days=400, hot=None, pools=1):
    """Matches in date order; with ``hot``, that team plays in a third of them."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        pool = rng.randrange(pools)
        names = [f"P{pool}T{k}" for k in range(teams)]
        home, away = rng.sample(names, 2)
        if hot is not None and i % 3 == 0:
            home, away = names[hot], rng.choice([t for t in names if t != names[hot]])
        rows.append(
            (
                i, day(rng.randrange(days)), home, away, rng.randrange(5), rng.randrange(4),
                rng.random() < 0.3, rng.choice(["Friendly", "FIFA World Cup", "Cup"]), str(pool),
            )
        )
    return sorted(rows, key=lambda r: (r[1], r[0]))


def ratings_by_hand(rows):
    """match_id -> (home before, away before); and team -> end rating."""
    sizes = {"Friendly": 20, "FIFA World Cup": 60}
    rating, last, out = {}, {}, {}
    for ident, date, home, away, hs, as_, neutral, tournament, pool in sorted(
        rows, key=lambda r: (r[1], r[0])
    ):
        now = []
        for team in ((pool, home), (pool, away)):
            value = rating.get(team, 1500.0)
            if team in last and (date - last[team]).days > 365:
                value -= 0.1 * (date - last[team]).days / 365 * (value - 1500)
            now.append(value)
        h, a = now
        out[ident] = (h, a)
        e = 1 / (1 + 10 ** ((a - h - (0 if neutral else 100)) / 400))
        s = 1.0 if hs > as_ else 0.5 if hs == as_ else 0.0
        k = sizes.get(tournament, 35)
        rating[pool, home], rating[pool, away] = h + k * (s - e), a + k * ((1 - s) - (1 - e))
        last[pool, home] = last[pool, away] = date
    return out, rating


def history_by_hand(rows, team, as_of, n):
    """The team's last n (gf, ga) strictly before a date, oldest first."""
    past = [r for r in rows if r[1] < as_of and team in (r[2], r[3])]
    past = sorted(past, key=lambda r: (r[1], r[0]))[-n:]
    return [(r[4], r[5]) if r[2] == team else (r[5], r[4]) for r in past]
