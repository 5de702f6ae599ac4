"""DataFrame operators over nodes, edges and text."""
