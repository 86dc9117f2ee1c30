"""Values, references and the function library."""
