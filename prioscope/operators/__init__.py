"""DataFrame to DataFrame operators of the audit."""
