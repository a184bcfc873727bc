"""Line lists that arrive as a stream."""
