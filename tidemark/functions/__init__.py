from tidemark.functions.scalars import sdiv

__all__ = ["sdiv"]
