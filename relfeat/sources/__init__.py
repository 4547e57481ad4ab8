"""Tables: declared schemas, databases, their checks, and where collected features go."""
