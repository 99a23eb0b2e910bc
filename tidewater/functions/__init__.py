"""Functions of the disclosure and price jobs."""
