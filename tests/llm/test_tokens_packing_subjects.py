import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import packing, subject_model, subjects, tokens
from docweave.llm.bpe import DEFAULT_VOCABULARY, encoder

needs_vocabulary = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no public vocabulary here")


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return t


@needs_vocabulary
def test_ids_equal_the_library():
    random.seed(5)
    parts = ["a", "b", "ế", "đ", "ng", " ", "\n", "1", ".", "'s", "’", "日", "😀", "​", "the", "ing", "ation", "  ", "<|endoftext|>", "Ж", "aaaa", "\r\n", "\t", "Điều "]
    texts = ["".join(random.choices(parts, k=random.randint(1, 60))) for _ in range(1500)] + ["a" * 3000, "ab" * 900, " " * 70, "=" * 999, "", "\n\n x"]
    ids, at = encoder().encode_all(texts)
    for k, r in enumerate(reference().encode_batch(texts, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == r.ids, texts[k]


def test_both_engines_split_alike():
    import regex

    from docweave.llm import bpe

    plane = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    random.seed(8)
    texts = [plane, " ".join(plane), *("".join(random.choices("aĐế1²½ \u00a0\t\n.'sll_\u0301日😀\x1c", k=40)) for _ in range(500))]
    assert all(bpe._splitter()(t) == regex.findall(bpe.PATTERN, t) for t in texts)


@needs_vocabulary
def test_speculation_agrees_with_exact_merging():
    e = encoder()
    random.seed(6)
    words = {"".join(random.choices("abcđêơnghtiu1", k=random.randint(1, 14))) for _ in range(3000)}
    e.learn(sorted(words))
    assert all(list(e.known[w]) == e.merge_exactly(w.encode()) for w in words)


@needs_vocabulary
def test_token_operators(spark):
    df = spark.createDataFrame([(1, "Điều 1."), (2, None), (3, ""), (4, "  "), (1, "Điều 1."), (None, "x"), (5, "rất dài " * 50_000)], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = [(r["doc_id"], r["ids"]) for r in tokens.token_ids(df, "doc_id", "text").collect()]
    assert Counter(k for k, _ in got) == Counter([1, 1, 2, 3, 4, 5, None]) and [v for k, v in got if k in (2, 3)] == [[], []]
    assert [v for k, v in got if k == 1] == [reference().encode("Điều 1.", add_special_tokens=False).ids] * 2
    counts = {(r["doc_id"]): r["tokens"] for r in tokens.token_counts(df, "doc_id", "text").collect()}
    assert counts[5] == len(next(v for k, v in got if k == 5)) and counts[2] == counts[3] == 0
    assert tokens.token_ids(df.limit(0), "doc_id", "text").count() == 0


def brute(items, capacity):
    free = []
    for s in sorted(items, reverse=True):
        fits = [f for f in free if f >= s]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - s)
        else:
            free.append(capacity - s)
    return sorted(free)


def test_best_fit_equals_item_by_item():
    random.seed(1)
    for _ in range(300):
        capacity = random.choice([10, 30, 100])
        items = [random.randint(1, capacity) for _ in range(random.randint(0, 80))]
        plan = packing.best_fit(list(Counter(items).items()), [capacity])
        assert sorted(capacity - used for _, n, _, used in plan.containers for _ in range(n)) == brute(items, capacity)
        load = Counter()
        for r in plan.runs:
            for j in range(r.count):
                load[r.container + j // r.each] += r.size
        assert dict(load) == {a + i: used for a, n, _, used in plan.containers for i in range(n)}


def placed(histogram, plan):
    """The load of each container, after checking that runs take every item once and boxes tell the truth."""
    load, ranks = Counter(), {}
    for r in plan.runs:
        ranks.setdefault(r.size, []).append((r.first, r.first + r.count))
        for j in range(r.count):
            load[r.container + j // r.each] += r.size
    for size, n in histogram:
        at = 0
        for first, end in sorted(ranks.get(size, [])):
            assert first == at
            at = end
        assert at == n
    assert dict(load) == {b.start + i: b.used for b in plan.containers for i in range(b.count)} and all(b.used <= b.capacity for b in plan.containers)
    return load


def test_joint_packing_takes_less_room_than_any_one_size():
    random.seed(2)
    room = lambda plan: sum(b.count * b.capacity for b in plan.containers)
    opened = set()
    for _ in range(60):
        histogram = list(Counter(random.choice([random.randint(1, 90), random.randint(1, 512)]) for _ in range(random.randint(1, 400))).items())
        plan = packing.best_fit(histogram, [32, 128, 512])
        placed(histogram, plan)
        opened |= {b.capacity for b in plan.containers}
        assert room(plan) <= room(packing.best_fit(histogram, [512]))
    assert opened == {32, 128, 512}
    few = [(300, 3), (100, 5), (20, 10), (5, 4)]
    plan = packing.best_fit(few, [32, 128, 512])
    placed(few, plan)
    assert room(plan) < room(packing.best_fit(few, [512])) and len({b.capacity for b in plan.containers}) > 1


def test_containers_half_empty_are_packed_anew():
    random.seed(4)
    for _ in range(200):
        capacities = sorted(random.sample(range(5, 60), 3))
        histogram = list(Counter(random.randint(1, capacities[-1]) for _ in range(random.randint(0, 200))).items())
        placed(histogram, packing.best_fit(histogram, capacities))
    plan = packing.best_fit([(1, 600)], [100, 1000])
    assert [(b.capacity, b.used) for b in plan.containers for _ in range(b.count)] == [(100, 100)] * 6


def test_pack(spark, monkeypatch):
    random.seed(3)
    rows = [(k, random.randint(1, 60)) for k in range(500)] + [(500, 260), (501, 0), (502, None), (503, 100), (7, 10), (None, 5), (504, -3)]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint").withColumn("packing", F.lit("clash")).withColumn("rank", F.lit(1))
    out = packing.pack(df, "doc_id", "n", {"small": {"small": 100}, "joint": {"small": 100, "tiny": 40}}).cache()
    for name in ("small", "joint"):
        mine = out.where(F.col("packing") == name)
        assert mine.agg(F.sum("tokens")).collect()[0][0] == sum(max(n or 0, 0) for _, n in rows)
        boxes = packing.containers(mine).collect()
        assert all(b["used"] <= b["capacity_tokens"] for b in boxes) and sum(b["used"] for b in boxes) / sum(b["capacity_tokens"] for b in boxes) > 0.97
        assert [(r["token_from"], r["tokens"]) for r in mine.where("doc_id = 500").orderBy("piece").collect()] == [(0, 100), (100, 100), (200, 60)]
        assert mine.where("doc_id in (501, 502, 504)").count() == 3 and mine.where("doc_id = 7").count() == 2 and mine.where("doc_id is null").count() == 1
        assert mine.groupBy("container_id").agg(F.count_distinct("capacity_code").alias("c")).where("c > 1").count() == 0
    rows_of = {r["packing"]: r for r in packing.waste(packing.containers(out)).groupBy("packing").agg(F.sum("used").alias("used"), F.sum("unused").alias("unused")).collect()}
    assert rows_of["small"]["used"] == rows_of["joint"]["used"] and rows_of["joint"]["unused"] <= rows_of["small"]["unused"]
    monkeypatch.setattr(packing, "BROADCAST_RUNS", 0)
    monkeypatch.setattr(packing, "BLOCK", 3)
    monkeypatch.setattr(packing, "RANKED_AT_ONCE", 2)
    again = packing.pack(df, "doc_id", "n", {"small": {"small": 100}, "joint": {"small": 100, "tiny": 40}})
    loads = lambda x: sorted((r["packing"], r["capacity_tokens"], r["used"]) for r in packing.containers(x).collect() if r["used"])
    assert loads(again) == loads(out)
    assert packing.pack(df.limit(0), "doc_id", "n", {"small": {"small": 100}}).count() == 0
    assert packing.pack(df.where("doc_id = 501"), "doc_id", "n", {"small": {"small": 100}}).collect()[0]["container_id"] == 0


TOPICS = {
    "land": ["sổ địa chính", "thửa đất ở", "khung giá đất", "ranh giới thu hồi"],
    "water": ["trạm bơm tiêu úng", "hồ điều hòa", "kênh tiêu chính", "mực nước báo động"],
    "sport": ["vận động viên", "bể bơi", "huấn luyện viên", "sân vận động"],
}
FRAMES = ["Danh mục {} được lập riêng cho từng xã.", "Đoạn đường dẫn tới nơi có {} được sửa trước mùa mưa.", "Không được thay đổi {} khi chưa có ý kiến.", "Hiện có 5 điểm cần xử lý liên quan đến {}."]


def corpus(n, seed):
    rng, rows, labels = random.Random(seed), [], []
    for k in range(n):
        own = rng.sample(sorted(TOPICS), rng.choice([1, 1, 2]))
        lines = [rng.choice(FRAMES).format(rng.choice(TOPICS[t])) for t in own for _ in range(6)]
        rows.append((k, "Căn cứ quy chế làm việc hiện hành;\n" + "\n".join(f"{i}. {s}" for i, s in enumerate(lines, 1)) + "\nLưu: VT, TH."))
        labels += [(k, t) for t in own]
    return rows, labels


def test_subjects(spark):
    rows, labels = corpus(160, 1)
    documents = spark.createDataFrame([*rows, (900, None), (901, " "), (902, "QUYẾT ĐỊNH:\nLưu: VT, TH."), (903, rows[0][1] * 300)], "doc_id bigint, text string").withColumn("subjects", F.lit("clash"))
    known = [x for x in labels if x[0] < 90]
    given = spark.createDataFrame([*known, *known[:9], (3, None), (4, "nothing"), *[(d, f" {t.upper()} ") for d, t in known[:5]]], "doc_id bigint, subject_code string")
    areas = spark.createDataFrame([(t,) for t in TOPICS], "subject_code string")
    found = {(r["doc_id"], r["subject_code"]) for r in subjects.subjects_of(documents, given, areas).collect()}
    unseen = {x for x in labels if x[0] >= 90}
    got = {x for x in found if 90 <= x[0] < 900}
    assert len(got & unseen) / len(unseen) > 0.95 and len(got & unseen) / len(got) > 0.95
    assert not {d for d, _ in found} & {900, 901, 902} and 903 in {d for d, _ in found}
    assert subjects.subjects_of(documents, given.limit(0), areas).count() == 0 and subjects.subjects_of(documents.limit(0), given, areas).count() == 0


def test_sentences():
    text = "ỦY BAN NHÂN DÂN HUYỆN PHÚ LẠC\nSố: 1/QĐ-UBND\nCăn cứ quy chế;\nĐiều 1. Kinh phí cho nhà ở xã\nhội là 5,2 triệu đồng. Tỷ lệ này tăng.\n1. Nạo vét kênh ......... 12\n| 3 | Danh mục nợ đọng được lập. | 7 |\nLưu: VT, TH."
    assert subject_model.sentences(text) == ["ỦY BAN NHÂN DÂN HUYỆN PHÚ LẠC Số: 1/QĐ-UBND Căn cứ quy chế;", "Kinh phí cho nhà ở xã hội là 5,2 triệu đồng.", "Tỷ lệ này tăng.", "Nạo vét kênh", "3 Danh mục nợ đọng được lập.", "Lưu: VT, TH."]
    assert subject_model.sentences("a;\nb;\nC;") == ["a; b;", "C;"] and subject_model.sentences("Có.\n12.\nĐ") == ["Có.", "Đ"]
    assert subject_model.sentences(None) == subject_model.sentences("") == subject_model.sentences(" \n ") == []
    long = "Ủy ban nhân dân cấp huyện có trách nhiệm biên soạn giáo trình tại phường Yên Trạch trước ngày 11/11/2023."
    assert subject_model.sentences(long + " Tỷ lệ này tăng.") == subject_model.sentences(long.replace("tại ", "tại\n") + "\nTỷ lệ này tăng.") == [long, "Tỷ lệ này tăng."]


def test_formal_sentences_are_learned_from_their_place():
    z = np.array([[-1, -1], [2, -1], [-1, -1], [-1, 3], [-1, -1], [-1, -1], [1, 9]], float)
    documents, labels = np.array([0, 0, 0, 0, 0, 1, 1]), np.array([[1, 1], [1, 0]], np.float32)
    assert subject_model.outside(z, documents, labels[documents]).tolist() == [1, 0, 0, 0, 1, 1, 0]
    targets, importance = subject_model.assign(z, documents, labels, False)
    assert targets.tolist() == [[1, 0, 1], [1, 0, 0], [1, 0, 0], [0, 1, 0], [1, 0, 1], [1, 0, 1], [1, 0, 0]] and importance.tolist() == [1, 1, 1, 1, 1, 1, 0]
    assert subject_model.outside(z[:0], documents[:0], labels[:0]).size == 0


def test_gradient_is_the_derivative():
    f = subject_model.training_features(["một hai ba", "bốn", ""])
    m = subject_model.Model(*(x.astype(np.float64) for x in subject_model.initial(2)))
    targets, weight = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0]], float), np.ones(3)
    touched, rows, outputs, _, loss = subject_model.gradient(f, m, targets, weight)
    moved = m.outputs.copy()
    moved[0, 0] += 1e-3
    after = subject_model.gradient(f, m._replace(outputs=moved), targets, weight)[4]
    assert abs((after - loss) / 1e-3 - outputs[0, 0]) < 1e-3
    moved = m.embeddings.copy()
    moved[touched[0], 1] += 1e-2
    after = subject_model.gradient(f, m._replace(embeddings=moved), targets, weight)[4]
    assert abs((after - loss) / 1e-2 - rows[0, 1]) < 1e-3
