"""Near duplicates where an id stands on rows of different texts."""

from plumbline.llm import minhash_dedup as m

from .test_dedup import brute_groups


def test_chains_of_ids_with_two_texts(spark):
    base = [f"t{i}" for i in range(120)]
    chain = []
    for i in range(40):
        ws = list(base)
        for j in range(i):
            ws[j * 3] = f"n{j}"
        chain.append((100 + i, " ".join(ws)))
    chain += [(i, " ".join([*base[:90], *(f"p{i}q{j}" for j in range(40))])) for i in range(60)]
    other = [(i, " ".join(f"o{i}x{j}" for j in range(30))) for i, _ in chain]
    docs = spark.createDataFrame(chain + other, "doc_id long, text string").repartition(4)
    want = {i: w[1:] for i, w in brute_groups(chain).items()}
    got = [(r["doc_id"], (r["component_id"], r["kept"])) for r in m.group(docs, m.Settings(block=8)).collect()]
    assert len(got) == 2 * len(chain) and all(v == want[i] for i, v in got)
