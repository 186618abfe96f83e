"""Words and phrases that the detectors look for."""

# The lexicons must be equal for equal findings.
AI_WORDS = [
    "delve", "delves", "delving", "tapestry", "testament", "meticulous", "meticulously", "intricate", "intricacies",
    "interplay", "underscore", "underscores", "underscoring", "boast", "boasts", "boasting", "bolster", "bolstered",
    "bolstering", "garner", "garners", "garnered", "pivotal", "vibrant", "multifaceted", "realm", "realms",
    "showcasing", "showcase", "showcases", "holistic", "seamless", "seamlessly", "myriad", "plethora", "enduring",
    "burgeoning", "unwavering", "indelible", "harness", "harnessing", "elevate", "elevates", "elevating", "foster",
    "fostering", "cultivate", "cultivating", "encompass", "encompassing", "commendable", "noteworthy", "paramount",
    "quintessential", "juncture", "advancements", "surpassing", "excels", "comprehending", "utilize", "utilizes",
    "utilizing", "transformative", "revolutionize", "revolutionise", "revolutionizing", "revolutionary",
    "pioneering", "unprecedented", "empower", "empowers", "empowering", "empowered", "streamline", "streamlines",
    "streamlined", "streamlining", "curated", "resonate", "resonates", "resonated", "underpin", "underpins",
    "underpinned", "spearhead", "spearheaded", "game-changing", "actionable", "supercharge", "turbocharge",
]
EMERGING = [
    "the real bottleneck", "load-bearing",
]
SIGNIFICANCE = [
    "underscores the importance", "highlights the importance", "reflects the broader", "reflects a broader",
    "part of a broader", "setting the stage for", "left an indelible mark", "leaving an indelible mark",
    "leaves an indelible mark", "rich tapestry", "rich cultural heritage", "rich history", "evolving landscape",
    "ever-evolving landscape", "ever-changing landscape", "changing landscape", "a shift in",
    "marks a turning point", "a key turning point", "deeply rooted in", "a lasting legacy", "enduring legacy",
    "stood the test of time", "a beacon of", "testament to the", "shaping the future", "shape the future",
    "the annals of history", "continues to captivate", "captured the hearts", "captures the essence", "a symbol of",
    "symbolizing the", "despite these challenges", "despite its challenges", "faces several challenges",
    "faces numerous challenges", "challenges and opportunities", "future outlook", "only time will tell",
    "one thing is clear", "one thing is certain", "the possibilities are endless", "the future is bright",
    "for generations to come", "now more than ever", "more than ever before", "continues to shape",
    "continues to inspire", "continues to evolve", "continues to grow", "is home to", "plays host to",
    "valuable insights", "pave the way", "paves the way", "paving the way", "paved the way",
]
PROMOTION = [
    "nestled in the heart of", "nestled in", "in the heart of", "a hidden gem", "hidden gem", "must-visit",
    "must-see", "breathtaking", "stunning natural beauty", "natural beauty", "picturesque", "state-of-the-art",
    "cutting-edge", "groundbreaking", "world-class", "renowned for", "renowned", "award-winning", "one-of-a-kind",
    "unparalleled", "unrivaled", "unrivalled", "rich cultural", "vibrant culture", "bustling", "a diverse array of",
    "diverse array", "wide array of", "a wide range of", "boasts a", "boasts an", "boasting a",
    "commitment to excellence", "commitment to", "dedicated to providing", "proud to", "we are proud",
    "game-changer", "game changer", "top-notch", "unforgettable experience", "immersive experience",
]
VAGUE_SOURCES = [
    "experts argue", "experts say", "experts believe", "experts agree", "many experts", "some experts",
    "critics argue", "critics say", "some critics", "observers have noted", "observers note", "observers say",
    "industry reports", "industry experts", "studies suggest", "studies show", "studies have shown",
    "research suggests", "research shows", "reports suggest", "it is widely regarded", "it is widely believed",
    "it is often said", "is often considered", "is considered one of the", "is widely considered",
    "is regarded as one of", "many believe", "some argue", "it is believed that", "according to sources",
    "sources say", "several sources", "various sources", "numerous sources", "a growing number of", "a number of",
    "countless",
]
OPENERS = [
    "moreover", "furthermore", "additionally", "firstly", "secondly", "thirdly", "in addition", "consequently",
    "notably", "importantly", "ultimately", "in conclusion", "in summary", "to summarize", "to sum up", "overall",
    "all in all", "in essence", "as a result", "that being said", "with that said", "on the other hand",
    "when it comes to", "in today’s world", "in today's world", "in the modern era", "in the world of",
]
CHATBOT = [
    "let us explore", "let's explore", "let's dive in", "let's dive into", "let's take a look", "let us delve",
    "in this article", "in this section", "in this guide", "this article will", "this guide will",
    "we will explore", "we will delve", "we will discuss", "as we navigate", "navigating the",
    "in the ever-changing world", "as an ai", "as a language model", "i cannot provide", "i do not have access",
    "as of my last", "my knowledge cutoff", "knowledge cutoff", "in the realm of", "when it comes to understanding",
    "unlock the", "unlock your", "take your", "to the next level", "the world of", "a myriad of", "from a to z",
    "the key takeaway", "key takeaways", "at the end of the day", "in an era of", "in an era where", "in an age of",
    "in an age where", "in a world where", "in a world increasingly", "at its core", "dive deeper", "a deep dive",
    "navigating the complexities", "the intersection of", "look no further", "say goodbye to", "say hello to",
    "buckle up", "without further ado", "that being said", "needless to say", "here's the kicker",
    "here's the thing", "let's break it down", "let's be real", "let's be honest", "the honest answer is",
    "the bottom line is", "no fluff", "chef's kiss", "it goes without saying", "have you ever wondered",
    "fast-paced world",
]
