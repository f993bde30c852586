"""The stateless operators on streams of flow files."""
