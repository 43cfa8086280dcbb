"""Schemas of the question bank's tables."""

OPTIONS = "array<struct<id:string,text:string>>"
ACTIONS = "array<struct<type:string,status:string,note:string>>"
QUESTION = (
    f"id string, seq long, question string, labels array<string>, source string, options {OPTIONS}, answerLabels array<string>, correctAnswers array<int>, answerExplanation string, "
    "chapter struct<number:int,title:string>, exam struct<number:int,questionNumber:int>, subtopic string, subtopicTags array<string>, confidence double, reviewStatus string, "
    f"repairFlags array<string>, repairActions {ACTIONS}, rawCandidate struct<question:string,options:{OPTIONS},answerLabels:array<string>>, "
    "sourceLocation struct<filePath:string,lineStart:int,lineEnd:int,sectionTitle:string>, contentHash string, duplicateOf string"
)
VERDICT = "fingerprint string, promptVersion string, complete boolean, optionsClean boolean, modelAnswer string, keyVerdict string, explanationMatches boolean, issues array<string>"
WORD_BOX = "page int, block int, par int, line int, left double, top double, right double, bottom double, text string"
