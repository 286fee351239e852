"""Tables, catalogue documents and report sinks."""
