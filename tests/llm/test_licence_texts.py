"""Licence texts inside documents, hard-wrapped and in comments."""

import random
import re
import textwrap

from weftline.llm import licences


def test_templates_inside_documents(spark):
    long = [(n, t) for n, t in licences.TEMPLATES if len(t.split()) > 20]
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "LGPL-2.1", "AGPL-3.0"} <= {n for n, _ in long}
    data = []
    for i, (_, t) in enumerate(long):
        for j, (lead, gap) in enumerate([("", "\n\n"), ("# ", "\n#\n"), (" * ", "\n *\n")]):
            wrapped = "\n".join(lead + x for x in textwrap.wrap(t, 70))
            data.append((3 * i + j, f"{lead}intro words{gap}{wrapped}{gap}{lead}other words of this file " + "and more " * 2000))
    got = {r.doc_id: r for r in licences.licence_matches(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for i, (name, _) in enumerate(long):
        assert all(got[3 * i + j].licence == name and got[3 * i + j].dice > 0.95 for j in range(3)), name


def shared_and_dice(a, b):
    a, b = set(zip(a, a[1:], strict=False)), set(zip(b, b[1:], strict=False))
    return len(a & b), 2 * len(a & b) / (len(a) + len(b))


def test_templates_within_a_paragraph_against_all_windows(spark):
    """Edited templates amid other words of one line, held against every window of a template's length."""
    rng = random.Random(5)
    cut = lambda t: re.findall(r"[^\W_]+", t.lower())
    known = [(n, cut(t)) for n, t in licences.TEMPLATES]
    data, best = [], {}
    for i in range(300):
        words = list(known[i % len(known)][1])
        for _ in range(rng.randrange(0, 1 + len(words) // 10)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["other"], [words[at], "more"]])
        text = [f"w{rng.randrange(99)}" for _ in range(rng.randrange(40))] + words + [f"v{rng.randrange(99)}" for _ in range(40)]
        data.append((i, " ".join(text)))
        every = [shared_and_dice(text[k : k + len(t)], t) for _, t in known for k in range(len(text))]
        best[i] = max((m for m in every if m[1] >= licences.DICE), default=None)
    got = {r.doc_id: r for r in licences.licence_matches(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    reached = [i for i in best if best[i]]
    found = [i for i in reached if got[i].n_matches]
    assert len(reached) > 150 and len(found) >= 0.95 * len(reached), (len(found), len(reached))
    # the best of all windows is the best of those found, or one about as good
    assert sum(got[i].dice >= best[i][1] - 0.05 for i in reached) >= 0.9 * len(reached)


def test_whole_licences_from_a_folder(spark, tmp_path):
    body = " ".join(f"clause{i} binds party{i % 7} hereby" for i in range(1500))
    (tmp_path / "Long-1.0.txt").write_text(body)
    (tmp_path / "Empty.txt").write_text("")
    (tmp_path / "Word").write_text("Solitary")
    templates = licences.template_files(str(tmp_path))
    assert [n for n, _ in templates] == ["Empty", "Long-1.0", "Word"]
    data = [(0, "before it " * 500 + body + " after it" * 500), (1, "none of this"), (2, None), (3, "\nsolitary\n")]
    got = {r.doc_id: r for r in licences.licence_matches(spark.createDataFrame(data, "doc_id long, text string"), templates).collect()}
    assert (got[0].licence, got[0].dice) == ("Long-1.0", 1.0) and got[3].licence == "Word"
    assert got[1].n_matches == got[2].n_matches == 0
