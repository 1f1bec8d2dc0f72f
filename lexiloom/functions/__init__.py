"""Column functions over texts, names and issue fields, and vectorised functions where order within a text matters."""
