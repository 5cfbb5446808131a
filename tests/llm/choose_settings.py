"""Choice of the settings of op7 and op9 by cross-validation within training rows.

Held-out rows (crc32 of the id modulo 3 is 1) are dropped before anything is learned or
measured. Prints, for each setting, the mean log loss over three folds of the rest, with recall and
false marks at the query's threshold; the setting with the least loss is the one in the module (for quality: of those in which words take part; stems of 64 letters: none).

    python tests/llm/choose_settings.py quality|toxic [directory]
"""

import itertools
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from quillstone.llm import quality, toxicity  # noqa: E402

FOLDS = 3


def training_rows(folder, label):
    texts = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    texts = dict(zip(texts["doc_id"], texts["text"]))
    rows = pq.read_table(f"{folder}/labels.parquet", columns=["doc_id", label]).to_pydict()
    for i, y in sorted(zip(rows["doc_id"], rows[label])):
        if y in (0, 1) and texts.get(i) is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            yield zlib.crc32(f"fold {i}".encode()) % FOLDS, y, texts[i]


def report(name, folds, threshold):
    p = np.clip(np.concatenate([p for _, p in folds]), 1e-6, 1 - 1e-6)
    y = np.concatenate([y for y, _ in folds])
    loss = -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))
    print(f"{loss:.5f} recall {np.mean(p[y == 1] >= threshold):.3f} false {np.mean(p[y == 0] >= threshold):.4f} {name}", flush=True)


def quality_settings(rows):
    counts = np.array([quality.term_counts(t) for _, _, t in rows])
    fold, y = np.array([f for f, _, _ in rows]), np.array([y for _, y, _ in rows])
    for weight, dimensions, neighbours in itertools.product((0.0, 0.25, 0.5, 1.0), (48, 96), (15,)):
        quality.WORD_WEIGHT, quality.DIMENSIONS, quality.NEIGHBOURS = weight, dimensions, neighbours
        folds = [(y[fold == k], quality.fit(counts[fold != k], y[fold != k]).scores(counts[fold == k])) for k in range(FOLDS)]
        report(f"word weight {weight}, dimensions {dimensions}, neighbours {neighbours}", folds, quality.THRESHOLD)


def toxicity_settings(rows):
    for stems, levels in (((64,), (1,)), ((3, 4, 5, 6, 7, 8), (1,)), ((3, 4, 5, 6, 7, 8), (1, 2, 4, 8))):
        toxicity.STEMS, toxicity.LEVELS = stems, levels
        words = toxicity.Words()
        slots = [words.slots(t) for _, _, t in rows]
        found = [toxicity.coordinates(s) for s in slots]
        for l1 in (1.0, 3.0, 6.0):
            toxicity.L1 = l1
            folds = []
            for k in range(FOLDS):
                w = toxicity.ftrl(toxicity.balanced([(y, c) for (f, y, _), c in zip(rows, found) if f != k]))
                bias = w.pop(-1, 0.0)
                at = np.array(sorted(w), np.int32)
                model = toxicity.Model(at, np.array([w[i] for i in at.tolist()], np.float32), bias)
                own = [(y, s) for (f, y, _), s in zip(rows, slots) if f == k]
                folds.append((np.array([y for y, _ in own]), np.array([model.score(s) for _, s in own])))
            report(f"stems {stems}, levels {levels}, L1 {l1}", folds, toxicity.THRESHOLD)


if __name__ == "__main__":
    what, folder = sys.argv[1], (sys.argv[2:] or ["/root/testdata/sf0.1"])[0]
    label = {"quality": "quality", "toxic": "toxic"}[what]
    rows = list(training_rows(folder, label))
    print(len(rows), "training rows,", sum(y for _, y, _ in rows), "of label 1")
    {"quality": quality_settings, "toxic": toxicity_settings}[what](rows)
