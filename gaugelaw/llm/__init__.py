"""Training-data operators: each module holds one operator and, where needed, its numpy helpers."""
