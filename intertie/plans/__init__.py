"""Complete jobs composed from readers, operators and writers."""
