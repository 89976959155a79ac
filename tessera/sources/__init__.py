"""Sources and sinks: files to text, key-wise rewriting of tables."""
