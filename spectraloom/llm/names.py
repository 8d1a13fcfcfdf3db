"""Column names that do not clash with a table's own."""


def free_name(name, columns):
    """`name`, with underscores appended while `columns` has it; names are compared without regard to case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
