import random

from terrane.llm import lines


def near(a: str, b: str) -> bool:
    """Edit distance 1 at most."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def edited(r: random.Random, line: str) -> str:
    for _ in range(r.choice((0, 1, 1, 1, 2))):
        p, c = r.randrange(len(line) + 1), r.choice("ab é日")
        line = r.choice((line[:p] + c + line[p:], line[:p] + line[p + 1 :], line[:p] + c + line[p + 1 :]))
    return line


def test_lines_as_brute_force(spark):
    r = random.Random(5)
    seeds = ["".join(r.choice("abc dé日") for _ in range(n)) for n in (*range(12, 42), 63, 64, 65, 130, 257, 900)] + ["a" * 40, "ab" * 20]
    docs = [(i, "\n".join(edited(r, r.choice(seeds)) for _ in range(6))) for i in range(150)] + [(150, None), (151, "")]
    seen, want = [], []
    for place, line in [((d, i), x.strip(" ")) for d, t in docs for i, x in enumerate((t or "").split("\n")) if x.strip(" ")]:
        if any(x == line or (min(len(x), len(line)) >= lines.NEAR and near(x, line)) for x in seen):
            want.append(place)
        seen.append(line)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((row.d, i) for row in lines.removals(frame).collect() for i in row.removed)
    assert len(want) > 100 and got == sorted(want)
