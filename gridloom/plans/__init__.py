"""Ready-made queries over the driver tables, one per operator."""

from importlib import import_module

TOPICS = ("clean", "graph", "routes", "tours", "retrieval", "chunks", "names_and_places", "scalars", "tables", "payloads", "own_index")


def load_all() -> None:
    """Import every topic module, so that its queries are registered."""
    for topic in TOPICS:
        import_module(f"gridloom.plans.{topic}")
