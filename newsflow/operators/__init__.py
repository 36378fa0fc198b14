"""DataFrame -> DataFrame steps; each works on batch and streaming input unless it
says otherwise."""
