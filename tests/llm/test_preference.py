"""Preference records against a plain loop, and against SQL."""

import pytest

from freshet.llm import preference as P
from freshet.llm.queries import QUERIES, SQL
from tests.oracle_check import connect, rows_of


def plain(chosen, rejected):
    key = lambda t: (P.LAST if t[0] is None else t[0], t[1] or "", t[2] or "")
    c, r = sorted(map(key, chosen)), sorted(map(key, rejected))
    turns = sorted({t[0] for t in c + r})
    cut = next((t for t in turns if [x for x in c if x[0] == t] != [x for x in r if x[0] == t]), None)
    keep = lambda x: cut is None or x[0] < cut
    show = lambda ts: "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for _, role, text in ts)

    def mask(ts):
        at, out = 0, []
        for _, role, text in ts:
            s = show([(0, role, text)])
            if role == "assistant":
                out.append((at + len(f"<|im_start|>{role}\n"), at + len(s) - 1))
            at += len(s)
        return out

    head, a, b = [x for x in c if keep(x)], [x for x in c if not keep(x)], [x for x in r if not keep(x)]
    return len(head), show(head), show(a) if c else None, mask(a), show(b) if r else None, mask(b), not a and not b


def test_records_match_a_loop(spark):
    a, b, c = (0, "system", "s"), (1, "user", "u é"), (2, "assistant", "one")
    convs = {
        1: [a, b, c, (3, "user", "more")], 2: [a, b, (2, "assistant", "two\n"), (3, "user", "x"), (4, "assistant", "long " * 20_000)], 3: [a, b, c], 4: [a, b, c],
        5: [(0, None, None), (None, "user", "last"), (1, "user", "b"), (1, "assistant", "a")], 6: [], 7: [(0, None, None), (1, "user", "b"), (1, "assistant", "a")],
    }
    rows = [(k, *t, "x") for k, ts in convs.items() for t in ts]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, side string")
    asked = [(1, 1, 2), (2, 3, 4), (3, 5, 7), (4, 1, 6), (5, 6, 8), (6, 1, 3), (7, 1, 4), (1, 1, 2)]
    pairs = spark.createDataFrame(asked, "pair_id bigint, chosen_id bigint, rejected_id bigint")
    got = P.format_pairs(turns, pairs).collect()
    assert len(got) == len(asked)
    for x in got:
        want = plain(convs.get(x.chosen_id, []), convs.get(x.rejected_id, []))
        mine = (x.n_prompt_turns, x.prompt, x.chosen, [(s.start, s.end) for s in x.chosen_mask], x.rejected, [(s.start, s.end) for s in x.rejected_mask], x.tied)
        assert mine == want
        for text, spans in ((x.chosen, x.chosen_mask), (x.rejected, x.rejected_mask)):
            assert all(text[s.start : s.end].endswith(P.CLOSE) for s in spans)
    assert P.format_pairs(turns.limit(0), P.neighbour_pairs(turns.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    cur = connect(sf).execute(SQL[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())
