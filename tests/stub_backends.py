"""Backends for tests; executors import them by name."""

from driftnet.embed import HashingBackend


class Seeing(HashingBackend):
    def __init__(self, cfg):
        super().__init__(cfg.embed_dim)

    def describe_image(self, path):
        return ("", "caption failed: dark") if path.endswith("dark.png") else ("a described image", "")

    def transcribe(self, path):
        return ("", "") if "silent" in path else ("a transcript", "")


class Dead(HashingBackend):
    """A model that fails on every text and image."""

    def __init__(self, cfg):
        super().__init__(cfg.embed_dim)

    def embed(self, texts):
        raise RuntimeError("out of memory")

    def describe_image(self, path):
        raise RuntimeError("out of memory")


class Blind(Dead):
    """A model that embeds but can't see."""

    def embed(self, texts):
        return HashingBackend.embed(self, texts)
