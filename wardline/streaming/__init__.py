"""The policies with state, over streams."""
