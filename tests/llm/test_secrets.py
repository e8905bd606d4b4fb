import base64
import random
import string

import numpy as np

from kgivm.llm.op4_secret_scan import candidates, labelled_findings, scan, train, vectors


def test_held_out_accuracy():
    forest = train(labelled_findings(2000, 1))
    held = labelled_findings(1000, 2)
    y = np.array([f[3] for f in held])
    p = forest.predict(vectors(held)) >= 0.5
    assert (p == y).mean() > 0.95
    assert (p & ~y).sum() / (~y).sum() < 0.06


def test_candidates_are_code_point_spans():
    text = 'é token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and pwd=hunter2hunter2.'
    assert [text[a:b] for a, b in candidates(text)] == ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "hunter2hunter2"]
    assert candidates("") == []


def test_scan(spark, docs):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [f'ünd token = "{key}" est', None, "", "Thtioninorerthblestthioning word", f"commit {key} merged", "plain words", f'a token = "{key}" b' * 3, "x" * 200_000]
    forest = train(labelled_findings())
    got = {r.doc_id: r for r in scan(docs(spark, texts), forest).collect()}
    assert {i: got[i].n_secrets for i in got} == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 3, 7: 0}
    a, b = map(int, got[0].spans.split(":"))
    assert texts[0][a:b] == key
    assert got[1].best is None and got[3].n_candidates == 1
    assert scan(docs(spark, []), forest).count() == 0


def test_whole_assigned_values_and_path_segments(spark, docs):
    value, key = "Tr0ub4dor&3correcthorsebattery", "ghp_a8Kd02mXq7Zr5Tn1Vw9Lc3Yb6Hs4Jf0PgQeRu"
    assert value in [x[a:b] for x in [f'password = "{value}"'] for a, b in candidates(x)]
    path = f"see https://git.example.com/repos/{key}/index.html now"
    assert key in [path[a:b] for a, b in candidates(path)]
    texts = [path, 'token = "24be64439e3e49cf46b2&d7c90f3602a3d0b907ff"']
    got = {r.doc_id: r for r in scan(docs(spark, texts), train(labelled_findings())).collect()}
    for i, r in got.items():
        ends = [tuple(map(int, x.split(":"))) for x in r.spans.split(",") if x]
        assert r.n_secrets == len(ends) and all(b <= c for (_, b), (c, _) in zip(ends, ends[1:]))
    assert key in "".join(texts[0][a:b] for a, b in [tuple(map(int, x.split(":"))) for x in got[0].spans.split(",")])


def other_kinds(rows=600, seed=11):
    """Findings of kinds that the training generator does not make."""
    r = random.Random(seed)
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    alnum, url = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_"
    names = "river stone market winter bridge garden letter cousin silver harbour castle meadow".split()
    join = lambda sep, n: sep.join(r.choice(names) for _ in range(n))
    secret = [
        lambda: ("Authorization: Bearer ", "eyJ" + pick(url, 18) + "." + pick(url, 60) + "." + pick(url, 43)), lambda: ("STRIPE=", "sk_live_" + pick(alnum, 24)), lambda: ("npm token ", "npm_" + pick(alnum, 36)),
        lambda: ("export AWS_SECRET_ACCESS_KEY=", pick(alnum + "/+", 40)), lambda: ("signing key: ", base64.b64encode(r.randbytes(32)).decode()), lambda: ("slack ", "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24)),
    ]
    tame = [
        lambda: ("see ", join("-", 4)), lambda: ("class ", "".join(w.capitalize() for w in join(" ", 4).split())), lambda: ("open ", "/home/" + join("/", 3) + ".txt"), lambda: ("build ", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 99)}-snapshot.{r.randint(10**7, 10**8)}"),
        lambda: ("index 3f ", pick("0123456789abcdef", 40) + ".." + pick("0123456789abcdef", 7)), lambda: ("at ", f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T1{r.randint(0, 9)}-30-00.000"), lambda: ("call ", join("_", 5) + "_id"),
        lambda: ("the ", join("", 4)),
    ]
    out = []
    for i in range(rows):
        lead, value = r.choice(secret if i % 2 else tame)()
        text = f"{join(' ', 4)} {lead}"
        out.append((f"{text}{value} {join(' ', 3)}", len(text), len(text) + len(value), bool(i % 2)))
    return out


def test_kinds_not_trained_on():
    held = other_kinds()
    y = np.array([f[3] for f in held])
    p = train(labelled_findings()).predict(vectors(held)) >= 0.5
    print(f"recall {p[y].mean():.3f} precision {y[p].mean():.3f}")
    assert p[y].mean() >= 0.9 and y[p].mean() >= 0.9
