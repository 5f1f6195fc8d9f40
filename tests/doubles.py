"""Embedders for tests; calls are counted in a file, as they happen in workers."""

from pathlib import Path


class Keyword:
    """Three keyword flags and a constant."""

    dim = 4

    def embed(self, text):
        t = text.lower()
        flags = [("auth", "login", "token"), ("schedule", "calendar", "meeting"), ("index", "sqlite", "fts")]
        return [*(float(any(w in t for w in ws)) for ws in flags), 0.5]


class Failing:
    def embed(self, text):
        raise RuntimeError("down")


class Dim:
    def __init__(self, dim):
        self.dim = dim

    def embed(self, text):
        return [1.0] + [0.0] * (self.dim - 1)


class Marker:
    """A vector with a marker, of a model and backend."""

    def __init__(self, mark, model="m", api=None, base_url=None):
        self.mark, self.model = float(mark), model
        if api:
            self.api, self.base_url = api, base_url

    def embed(self, text):
        return [self.mark, 0.0, 0.0, 1.0]


class Batch:
    def __init__(self, log):
        self.log = str(log)

    def embed(self, text):
        return [1.0, 0.5]

    def embed_batch(self, texts):
        with Path(self.log).open("a") as f:
            f.write(f"{len(texts)}\n")
        return [[1.0, 0.5] for _ in texts]


class FailingBatch(Batch):
    def embed_batch(self, texts):
        super().embed_batch(texts)
        raise RuntimeError("down")


def batches(log):
    return [int(x) for x in Path(log).read_text().split()] if Path(log).exists() else []
