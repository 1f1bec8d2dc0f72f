"""Beyond parity: micro-batches of new document pairs."""
